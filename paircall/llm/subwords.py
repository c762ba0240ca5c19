"""Byte-level BPE ids of whole texts, with a memo of pieces that stays in the Python worker.

A single space or line end between two characters that are no white space is always a border of the tokenizer's own
splitting, so a text is cut there and equal pieces are encoded once. Texts with other white space are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np

MEMO = 2_500_000  # pieces that a worker remembers, at about 175 bytes each
ROW = 64  # pieces that are encoded as one text, which costs half as much as each on its own
# What keeps a text from being cut: white space in runs or of another kind, and the mark used for cutting.
_ODD = ("  ", " \n", "\n ", "\n\n", "\x00", *(chr(c) for c in range(9, 0x3001) if chr(c).isspace() and chr(c) not in " \n"))
_ODD_ASCII = tuple(o for o in _ODD if o.isascii())
_loaded: dict[str, "Encoder"] = {}


def odd(text: str) -> bool:
    return any(map(text.__contains__, _ODD_ASCII if text.isascii() else _ODD)) or text[:1].isspace() or text[-1:].isspace()


class Memo(dict):
    """Ids by piece; a piece that is not known yet is noted in `new`."""

    def __init__(self, known: dict[str, bytes]):
        super().__init__(known)
        self.new: set[str] = set()

    def __missing__(self, piece: str) -> None:
        self.new.add(piece)


class Encoder:
    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.limit = memo
        self._clear()

    def _clear(self) -> None:
        self.memo = Memo({"": b"", "\n": np.array([self.line], dtype=self.dtype).tobytes()})

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Rows of pieces are encoded as lines of one text; a line end between pieces is always an id of its own."""
        done = []
        for row in self._encode(["\n".join(pieces[i : i + ROW]) for i in range(0, len(pieces), ROW)]):
            ids = np.frombuffer(row, dtype=self.dtype)
            ends = np.append(np.flatnonzero(ids == self.line), len(ids)) * self.dtype.itemsize
            begins = np.append(0, ends[:-1] + self.dtype.itemsize)
            done += [row[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        return done

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as `dtype`."""
        if len(self.memo) > self.limit:
            self._clear()
        memo, found = self.memo, []
        for text in texts:
            pieces = None if odd(text) else text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
            found.append((pieces, pieces and list(map(memo.__getitem__, pieces))))
        new = list(memo.new)
        memo.update(zip(new, self._encode_pieces(new), strict=True))
        memo.new.clear()
        whole = iter(self._encode([t for t, (pieces, _) in zip(texts, found, strict=True) if pieces is None]))
        return [next(whole) if pieces is None else self._joined(pieces, ids) for pieces, ids in found]

    def _joined(self, pieces: list[str], ids: list[bytes | None]) -> bytes:
        if None in ids:
            memo = self.memo
            ids = [memo[p] if i is None else i for p, i in zip(pieces, ids)]
        return b"".join(ids)


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    _loaded[path].limit = memo
    return _loaded[path]
