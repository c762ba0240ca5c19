"""Segments of alignments with many CIGAR operations, a batch at a time.

Positions in the reference and in the read are running sums over a read's operations. They are taken once over all
operations of an Arrow batch and made relative to the read's first one, so the cost is linear in the operations, however
many a read has. (An expression that folds over a read's operations copies the segments found so far at each one.)
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cigar import CIGAR_PATTERN

_LETTERS = "MIDNSHP=X"
_KIND = {letter: at for at, letter in enumerate(_LETTERS)}
_TO_REFERENCE = np.array([letter in "MDN=X" for letter in _LETTERS])
_TO_READ = np.array([letter in "MIS=X" for letter in _LETTERS])
_KINDS = np.full(256, -1, dtype=np.int8)
for _letter, _at in _KIND.items():
    _KINDS[[ord(_letter), ord(_letter.lower())]] = _at
_SOUND = re.compile(f"(?:{CIGAR_PATTERN})*")

SEGMENT = "struct<ref:int,query:int,len:int,op:string,indel:int>"


def operations(cigars: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and kinds of all operations, and how many each string has; what is no operation is left out."""
    sound = [c if _SOUND.fullmatch(c) else "".join(n + op for n, op in re.findall(CIGAR_PATTERN, c)) for c in cigars]
    text = np.frombuffer("".join(sound).encode("ascii"), np.uint8)
    letters = np.flatnonzero(_KINDS[text] >= 0)
    digits = np.flatnonzero(_KINDS[text] < 0)
    owner = np.searchsorted(letters, digits)
    # At most ten digits count, as a longer number is no position.
    value = (text[digits] - 48).astype(np.float64) * 10.0 ** np.minimum(letters[owner] - digits - 1, 300)
    lengths = np.bincount(owner, weights=value, minlength=len(letters))
    ends = np.cumsum([len(c) for c in sound])
    counts = np.diff(np.concatenate(([0], np.searchsorted(letters, ends))))
    return np.minimum(lengths, 2**31 - 1).astype(np.int64), _KINDS[text[letters]].astype(np.int64), counts


def _before(steps: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the steps of the same read before each operation."""
    total = np.cumsum(steps) - steps
    return total - np.repeat(total[first[counts > 0]], counts[counts > 0])


def indels(lengths: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length change right after each operation: inserted bases, or minus the deleted ones.

    After a pad, the insertions up to the next operation on the reference add up.
    """
    last = np.zeros(len(kinds), dtype=bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    following, length = np.append(kinds[1:], -1), np.append(lengths[1:], 0)
    found = np.where(following == _KIND["I"], length, 0) - np.where(following == _KIND["D"], length, 0)
    pads = np.flatnonzero((following == _KIND["P"]) & ~last)
    if len(pads):
        read = np.repeat(np.arange(len(counts)), counts)
        inserted = np.concatenate(([0], np.cumsum(np.where(kinds == _KIND["I"], lengths, 0))))
        stops = np.append(np.flatnonzero(_TO_REFERENCE[kinds]), len(kinds))
        until = np.minimum(stops[np.searchsorted(stops, pads + 2)], np.cumsum(counts)[read[pads]])
        found[pads] = inserted[until] - inserted[np.minimum(pads + 2, until)]
    found[last] = 0
    return found


def segment_arrays(cigar: pa.Array, pos: pa.Array) -> pa.Array:
    """A list of SEGMENT per read, null for a null CIGAR; one entry per operation on the reference."""
    lengths, kinds, counts = operations([c or "" for c in cigar.to_pylist()])
    first = np.cumsum(counts) - counts
    starts = np.repeat(pos.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), counts)
    reference = starts + _before(np.where(_TO_REFERENCE[kinds], lengths, 0), first, counts)
    query = _before(np.where(_TO_READ[kinds], lengths, 0), first, counts)
    kept = np.flatnonzero(_TO_REFERENCE[kinds])
    sizes = np.bincount(np.repeat(np.arange(len(counts)), counts)[kept], minlength=len(counts))
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    whole = lambda x: pa.array(np.clip(x[kept], -(2**31), 2**31 - 1).astype(np.int32))
    ops = pa.DictionaryArray.from_arrays(pa.array(kinds[kept].astype(np.int8)), pa.array(list(_LETTERS))).cast(pa.string())
    entries = pa.StructArray.from_arrays(
        [whole(reference), whole(query), whole(lengths), ops, whole(indels(lengths, kinds, counts))], ["ref", "query", "len", "op", "indel"]
    )
    return pa.ListArray.from_arrays(pa.array(ends), entries, mask=cigar.is_null())


def segments(cigar: Column, pos: Column) -> Column:
    """`segment_arrays` of two columns."""

    def batch(cigar: pa.Array, pos: pa.Array) -> pa.Array:
        return segment_arrays(cigar, pos)

    return F.arrow_udf(batch, f"array<{SEGMENT}>")(cigar, pos)
