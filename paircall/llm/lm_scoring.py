"""Language-model scores of whole texts, beside those of smoothed word frequencies.

Texts are lines of words (A-Z in lower case, cut at ASCII white space) and one end. The model reads them as subword
ids: each word, with a space before it, merged by the ranks of a public byte-level vocabulary, then an end id.

Learning covers all training texts. Words are counted in one pass, and the ids' counts follow from them; these set the
model's vocabulary. A second pass draws about START slices of 16 words by a hash, and at least one of every text; START
of them (the smallest hashes) give the weights that training starts from, on the driver. Then every task trains on every
token of all texts of its own partition from there, and Spark averages the weights by numbers of tokens. What is gathered (counts,
slices) grows with the input; what is collected or sent to tasks does not: START slices, one vector of weights, the
counts of 50,000 ids and of the HEAVY most frequent words.

Scoring is one pass over all texts. A text's words that are not among the HEAVY ones are looked up by a join; none of
them is frequent enough to make a hot key.

Defined results: a null text is empty and has the end only. Texts without a doc_id are trained on. Rows that share a
doc_id are scored on their own. An empty table gives an empty result; without training texts the model is the fresh
one. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import Adam, Model, Vocabulary, blocks, blocks_of, keep_memory
from .common import stored, text_or_empty

END = 50256
SLICE = 16  # words of a slice
START, STEPS, EPOCHS, RATE = 150_000, 4_000, 20, 8e-3
BATCH, TUNE = 256, 5e-4  # blocks of a step, the tasks' rate
HEAVY = 200_000
FLUSH, MEMO, LONG, DOCS = 400_000, 1_200_000, 1 << 20, 128
PIECE = 64  # bytes of a word that are encoded at once
ONE = slice(0, 1)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes):
    """The words of a UTF-8 text, some at a time: a very long text must not become one list.

    In bytes, lower() changes A-Z only and split() cuts at ASCII white space only.
    """
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + LONG) if len(text) - at > LONG else None
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def text_bytes(column):
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def subwords(path: str):
    """A function from a word to its packed ids, by byte pair ranks; a space goes before the word."""
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def packed(word: bytes) -> bytes:
        if len(word) < PIECE:
            return array("H", encode(b" " + word)).tobytes()
        word = b" " + word  # the longest words are cut, so that merging stays cheap
        return b"".join(array("H", encode(word[i : i + PIECE])).tobytes() for i in range(0, len(word), PIECE))

    return packed


class Numbers(dict):
    """Numbers of words; one that is not known yet is noted in `new` and has -1."""

    def __init__(self):
        super().__init__()
        self.new: set[bytes] = set()

    def __missing__(self, word: bytes) -> int:
        self.new.add(word)
        return -1


class Words:
    """Ids and log counts of the words seen, remembered by the worker from task to task; forgotten when full.

    A line end, which no word can be, stands for the end of a text.
    """

    def __init__(self, vocabulary: str):
        self.packed, self.counts = subwords(vocabulary), {}
        self._clear()

    def _clear(self):
        self.at = Numbers()
        self.used = 0
        self.ids, self.begin, self.size, self.log = (np.empty(1 << 16, t) for t in ("<u2", np.int64, np.int64, float))

    def bind(self, counts: dict[bytes, int]) -> "Words":
        """From now on log counts are of `counts`; words not in there have none."""
        if counts is not self.counts:
            self.counts = counts
            self._logs(0, list(self.at))
        return self

    def _logs(self, first: int, words: list[bytes]) -> None:
        counts = np.array([self.counts.get(w, 0) for w in words], dtype=float)
        self.log[first : first + len(words)] = np.where(counts > 0, np.log10(counts + 0.5), np.nan)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, good until the next call."""
        if len(self.at) > MEMO:
            self._clear()
        found = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        if self.at.new:
            self._add(list(self.at.new))
            self.at.new.clear()
            gaps = np.flatnonzero(found < 0)
            found[gaps] = [self.at[words[i]] for i in gaps.tolist()]
        return found

    def _add(self, new: list[bytes]) -> None:
        found = [_END if w == b"\n" else self.packed(w) for w in new]
        data, first = b"".join(found), len(self.at)
        sizes = np.array([len(f) // 2 for f in found], dtype=np.int64)
        self.ids = _room(self.ids, self.used + len(data) // 2)
        self.begin, self.size, self.log = (_room(x, first + len(new)) for x in (self.begin, self.size, self.log))
        here = slice(first, first + len(new))
        self.ids[self.used : self.used + len(data) // 2] = np.frombuffer(data, "<u2")
        self.begin[here], self.size[here] = self.used + np.cumsum(sizes) - sizes, sizes
        self._logs(first, new)
        self.used += len(data) // 2
        self.at.update(zip(new, range(first, first + len(new)), strict=True))

    def line(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the words, one word after the other."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        if not len(ends):
            return np.empty(0, "<u2")
        return self.ids[np.arange(ends[-1]) + np.repeat(self.begin[numbers] - ends + size, size)]


_END = np.array([END], dtype="<u2").tobytes()
_known: dict[str, Words] = {}


def known_words(vocabulary: str) -> Words:
    """The worker's words for a vocabulary file."""
    if vocabulary not in _known:
        _known[vocabulary] = Words(vocabulary)
    return _known[vocabulary]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups, none of them empty."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.empty(max(n, 2 * len(x)) - len(x), x.dtype)])


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def flush(counts: Counter):
        import pyarrow as pa

        names = pa.array(counts.keys(), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def task(batches):
        counts = Counter()
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                for some in pieces(text):
                    counts.update(some)
                if len(counts) > FLUSH:
                    yield flush(counts)
                    counts = Counter()
        if counts:
            yield flush(counts)

    return texts.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_ids(counts: DataFrame, vocabulary: str) -> np.ndarray:
    """Counts of all ids, from the counts of all words."""

    def task(batches):
        import pyarrow as pa

        packed = subwords(vocabulary)
        total = np.zeros(1 << 16)
        for batch in batches:
            found = [packed(word) for word in text_bytes(batch.column("word"))]
            ids = np.frombuffer(b"".join(found), "<u2")
            total += np.bincount(ids, weights=np.repeat(batch.column("n").to_numpy(), [len(f) // 2 for f in found]), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen].astype(np.int64))], names=["id", "n"])

    found = counts.mapInArrow(task, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(END + 1)
    total[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return total


def draw_slices(texts: DataFrame, vocabulary: str, rate: float) -> DataFrame:
    """(h, ids): slices of all texts, a share of `rate` by a hash and at least one of each text."""
    limit = int(min(1.0, rate) * (1 << 64))

    def drawn(text: bytes):
        import xxhash

        base, at, taken, least = xxhash.xxh64_intdigest(text), 0, [], None
        lists = [words for words in pieces(text) if words] or [[]]
        for k, words in enumerate(lists):
            for i in range(0, max(1, len(words)), SLICE):
                h = xxhash.xxh64_intdigest(at.to_bytes(8, "little"), base)
                here = (h, at == 0, words[i : i + SLICE], k == len(lists) - 1 and i + SLICE >= len(words))
                if h < limit:
                    taken.append(here)
                elif least is None or h < least[0]:
                    least = here
                at += 1
        return taken or [least]

    def task(batches):
        import pyarrow as pa

        known = known_words(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                found = [s for text in text_bytes(batch.slice(at, DOCS).column("text")) for s in drawn(text)]
                lists = [[b"\n"] * first + words + [b"\n"] * last for _, first, words, last in found]
                numbers = known.numbers(list(chain.from_iterable(lists)))
                ends = np.cumsum(_sums(known.size[numbers], np.array([len(w) for w in lists]))) * 2
                data = known.line(numbers).tobytes()
                ids = [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
                hashes = np.array([s[0] for s in found], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids, pa.binary())], names=["h", "ids"])

    return texts.mapInArrow(task, "h long, ids binary")


def _lines(rows, vocabulary: Vocabulary) -> list[np.ndarray]:
    lines = [vocabulary.leaf[np.frombuffer(ids, "<u2")] for ids in rows]
    return [line for line in lines if len(line) > 1]


def whole_lines(known: Words, texts: list[bytes]):
    """(ids, lengths) of lines that hold every token of the texts, ends included, once beside a first one.

    A text is a line between two ends; a very long one is a line for each piece, which begins with the last id before.
    """
    small = [t for t in texts if len(t) <= LONG]
    if small:
        lists = [[b"\n", *next(pieces(t), []), b"\n"] for t in small]
        numbers = known.numbers(list(chain.from_iterable(lists)))
        yield known.line(numbers), _sums(known.size[numbers], np.array([len(x) for x in lists]))
    for text in texts:
        if len(text) > LONG:
            last = np.array([END], dtype="<u2")
            for words in chain(pieces(text), [[b"\n"]]):
                if words:
                    line = np.concatenate([last, known.line(known.numbers(words))])
                    yield line, np.array([len(line)])
                    last = line[-1:]


def tuned_weights(texts: DataFrame, vocabulary: str, model: Model, leaves: Vocabulary) -> DataFrame:
    """(tokens, weights): the weights of each task, which has trained on every token of its texts, starting from `model`."""
    weights = texts.sparkSession.sparkContext.broadcast(model.vector)

    def tune(batches):
        import pyarrow as pa

        keep_memory()
        known, own, tokens = known_words(vocabulary), Model(weights.value.copy()), 0
        learn = Adam(own, TUNE)
        for batch in batches:
            for part in range(0, batch.num_rows, DOCS):
                for flat, lengths in whole_lines(known, text_bytes(batch.slice(part, DOCS).column("text"))):
                    inputs, targets, starts, _ = blocks_of(leaves.leaf[flat], lengths)
                    for at in range(0, len(inputs), BATCH):
                        some = slice(at, at + BATCH)
                        starts[at] = True  # the block before is not in this step
                        learn(inputs[some], targets[some], starts[some])
                    tokens += int((lengths - 1).sum())
        if tokens:
            made = pa.array([own.vector], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([tokens]), made], names=["tokens", "weights"])

    return texts.mapInArrow(tune, "tokens long, weights array<float>")


def train(texts: DataFrame, vocabulary: str, counts: DataFrame) -> tuple[Model, Vocabulary]:
    """The model from all training texts."""
    ids = count_ids(counts, vocabulary)
    ids[END] += texts.count()
    leaves = Vocabulary(ids)
    slices = draw_slices(texts, vocabulary, START * SLICE / max(1, ids.sum()))
    first = _lines(slices.orderBy("h", "ids").limit(START).toArrow().column("ids").to_pylist(), leaves)
    model = Model.fresh(leaves)
    if not first:
        return model, leaves
    keep_memory()
    parts, draw = blocks(first)[:3], np.random.default_rng(3)
    steps = min(STEPS, max(50, EPOCHS * len(parts[0]) // BATCH))
    learn = Adam(model, RATE)
    for step in range(steps):
        at = int(draw.integers(0, max(1, len(parts[0]) - BATCH)))
        some = [p[at : at + BATCH] for p in parts]
        learn(*some, rate=1 - 0.95 * step / steps)

    tuned = tuned_weights(texts, vocabulary, model, leaves).select("tokens", F.posexplode("weights"))
    mean = F.sum(F.col("col").cast("double") * F.col("tokens")) / F.sum("tokens")
    found = tuned.groupBy("pos").agg(mean.alias("weight")).toArrow()
    vector = np.empty(Model.size(), dtype=np.float32)
    vector[found.column("pos").to_numpy()] = found.column("weight").to_numpy()
    return Model(vector), leaves


def _read(known: Words, texts: list[bytes]):
    """Of some texts: lengths in ids and in words with both ends, all ids, sums of known log counts, and words without one."""
    import pyarrow as pa

    lines, parts, sizes = [], [], np.zeros(len(texts), dtype=np.int64)
    lengths, logs, missing, lost = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), [], np.zeros(len(texts), dtype=np.int64)
    if len(texts) == 1:
        parts = chain([(ONE, [[b"\n"]])], ((ONE, [words]) for words in pieces(texts[0]) if words), [(ONE, [[b"\n"]])])
    else:
        parts = [(slice(None), [[b"\n", *next(pieces(t), []), b"\n"] for t in texts])]
    for at, lists in parts:
        words = list(chain.from_iterable(lists))
        numbers, counts = known.numbers(words), np.array([len(x) for x in lists])
        log = known.log[numbers]
        none = np.isnan(log)
        gone = [i for i in np.flatnonzero(none).tolist() if words[i] != b"\n"]
        missing += [words[i] for i in gone]
        owner = np.repeat(np.arange(len(lists)), counts)
        lines.append(known.line(numbers))
        sizes[at] += counts
        lengths[at] += _sums(known.size[numbers], counts)
        logs[at] += _sums(np.where(none, 0, log), counts)
        lost[at] += np.bincount(owner[gone], minlength=len(lists))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lost)]), pa.int32())
    rare = pa.ListArray.from_arrays(offsets, pa.array(missing, pa.binary()).cast(pa.string()))
    return lengths, sizes, np.concatenate(lines).astype(np.int64), logs, rare


def held_out(column: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(docs: DataFrame, vocabulary: str, is_held_out: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_or_empty().alias("text"), (held_out() if is_held_out is None else is_held_out).alias("held_out"))
    texts = docs.where("NOT held_out").select("text")
    counts = stored(count_words(texts), "words")
    model, leaves = train(texts, vocabulary, counts)
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()
    ends = texts.count()
    tokens = (totals["n"] or 0) + ends
    unseen = math.log10(tokens + 0.5 * (totals["words"] + (ends > 0) + 1))
    end = math.log10(ends + 0.5)
    heavy = counts.orderBy(F.col("n").desc(), "word").limit(HEAVY).select(F.col("word").cast("binary").alias("word"), "n").toArrow()
    heavy = dict(zip(heavy.column("word").to_pylist(), heavy.column("n").to_pylist(), strict=True))
    shared = spark.sparkContext.broadcast((model.vector, leaves, heavy))

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        keep_memory()
        vector, leaves, heavy = shared.value
        model, known = Model(vector), known_words(vocabulary).bind(heavy)
        # Texts without words have one score, which must not depend on what shares their batch.
        _, _, line, _, _ = _read(known, [b""])
        nothing = float(model.scores(*blocks_of(leaves.leaf[line], np.array([len(line)]))[:3]).sum(dtype=float))
        nothing += float(leaves.share[line].astype(float).sum() - leaves.share[END])
        # Numbers rows; they are stored with the row, so a repeated task cannot disturb them.
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                texts = text_bytes(part.column("text"))
                # A very long text is a batch of its own, and read some words at a time.
                small = [i for i, t in enumerate(texts) if len(t) <= LONG]
                groups = [small] * bool(small) + [[i] for i, t in enumerate(texts) if len(t) > LONG]
                for group in groups:
                    lengths, sizes, flat, logs, rare = _read(known, [texts[i] for i in group])
                    n = sizes - 1  # the words and one end; the line has an end at either side
                    inputs, targets, starts, owner = blocks_of(leaves.leaf[flat], lengths)
                    found = np.bincount(owner, weights=model.scores(inputs, targets, starts).sum(1, dtype=float), minlength=len(group))
                    found += _sums(leaves.share[flat].astype(float), lengths) - leaves.share[END]
                    found = np.where(n == 1, nothing, found)
                    own = part.take(pa.array(group))
                    made = [
                        pa.array(np.arange(row, row + len(group))), own.column("doc_id"), own.column("held_out"), pa.array(n),
                        pa.array(logs + end - n * unseen), pa.array(found / math.log(10)), rare,
                    ]
                    row += len(group)
                    yield pa.RecordBatch.from_arrays(made, names=["row", "doc_id", "held_out", "n_tokens", "base", "score", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(docs.mapInArrow(task, f"row long, doc_id {kind}, held_out boolean, n_tokens long, base double, score double, rare array<string>"), "scores")
    words = found.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    more = words.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count_if(F.col("n").isNull()).alias("new"))
    # An end is known if there is a training text.
    known = F.col("n_tokens") - F.coalesce("new", F.lit(0)) - F.lit(int(ends == 0))
    return found.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
