"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ from a passage by n // 20 edits (insertions, deletions, replacements). Cut into one
piece more than that, at least one piece must occur unchanged. An automaton finds all pieces in a text in one pass;
each hit names a diagonal, and the text around the diagonals that lie close together is checked once, by Myers' bit-
parallel distance. Case and kind of ASCII white space do not count; folding keeps lengths, so spans hold in the text.

Items go to the tasks in groups of at most about GROUP characters, one pass over the documents per group, so neither
driver nor tasks hold more, however large the benchmark.

Defined results: one row per document row and matching item, with the least distance, of these the first span. Null
and empty texts match nothing; null and empty items are not looked for. Items that repeat are each reported. Only
`doc_id` and `text` are read (`item_id` and `text` of the benchmark). Spans count code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, row_of, text_or_empty, texts_of

EDITS = 20  # characters per allowed edit
GROUP = 8_000_000
DOCS = 256  # documents that are read at once
_SPACE = {c: " " for c in range(9, 14)}


def fold(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_SPACE)


def pieces(item: str) -> list[tuple[int, str]]:
    """Budget plus one pieces of nearly equal length, with their offsets."""
    n = len(item) // EDITS + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def ends(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of the text, and the first end where it occurs.

    Bit i of `up` (`down`) says that the distance grows (shrinks) from row i to i+1 of the current column; whole
    columns are updated at once in integers of any width.
    """
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        grow, shrink = down | ~(across | up) & full, up & across
        score += bool(grow & top) - bool(shrink & top)
        if score < best:
            best, at = score, j
        grow, shrink = grow << 1 & full, shrink << 1 & full
        vertical = eq | down
        up, down = shrink | ~(vertical | grow) & full, grow & vertical
    return best, at


def best_span(item: str, text: str) -> tuple[int, int, int]:
    """Least distance, start and end."""
    distance, end = ends(item, text)
    if distance == len(item):
        return distance, 0, 0
    _, back = ends(item[::-1], text[:end][::-1])
    return distance, end - back, end


class Finder:
    """All pieces of a group of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, folded) for i, text in items if (folded := fold(text))]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, item) in enumerate(self.items):
            for offset, piece in pieces(item):
                places.setdefault(piece, []).append((number, offset))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the items within their budget."""
        if not self.items or not text:
            return []
        text, diagonals = fold(text), {}
        for last, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                diagonals.setdefault(number, set()).add(last + 1 - length - offset)
        found = []
        for number, places in diagonals.items():
            item_id, item = self.items[number]
            budget, best = len(item) // EDITS, None
            places, at = sorted(places), 0
            while at < len(places):
                # Diagonals that may belong to one match are checked together; the window grows by at most one match.
                first = last = places[at]
                while at < len(places) and places[at] <= min(last + 2 * budget, first + len(item)):
                    last, at = places[at], at + 1
                begin = max(0, first - budget)
                distance, start, end = best_span(item, text[begin : last + len(item) + budget])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, begin + start, begin + end)
            if best:
                found.append((item_id, *best))
        return found


def item_groups(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of about GROUP characters by a hash, one group on the driver at a time; at least one group."""
    items = benchmark.where("text IS NOT NULL AND text <> ''").select("item_id", "text")
    groups = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // GROUP))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    for group in range(groups):
        yield [tuple(row) for row in items.where(number == group).collect()]


def find(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per document row and item: `row` (a struct of `columns`, by default doc_id), item_id, distance, start, end."""
    rows = docs.select(row_of(columns or ["doc_id"]), text_or_empty().alias("text"))
    shape = rows.select("row").schema
    shape = shape.add("item_id", "long").add("distance", "integer").add("start", "integer").add("end", "integer")
    found = None
    for some in item_groups(benchmark):
        part = rows.mapInArrow(_task(some), shape)
        found = part if found is None else found.unionAll(part)
    return found


def _task(items: list[tuple[int, str]]):
    def task(batches):
        import pyarrow as pa

        finder = Finder(items)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                here = finder.matches(text)
                at += [i] * len(here)
                found += here
            if at:
                table = pd.DataFrame(found, columns=["item_id", "distance", "start", "end"])
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                arrays = [batch.column("row").take(pa.array(at)), *(pa.array(table[c], k, from_pandas=True) for c, k in zip(table, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", *table])

    return task


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found; each row is judged by its own text."""
    rows = carried(docs, docs.columns)
    for some in item_groups(benchmark):
        rows = rows.mapInArrow(_keep(some), rows.schema)
    return rows.select("row.*")


def _keep(items: list[tuple[int, str]]):
    def task(batches):
        import pyarrow as pa

        finder = Finder(items)
        for batch in batches:
            for i in range(0, batch.num_rows, DOCS):
                part = batch.slice(i, DOCS)
                yield part.filter(pa.array([not finder.matches(t) for t in texts_of(part)], pa.bool_()))

    return task


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find(docs, benchmark).select("row.doc_id", "item_id", "distance", "start", "end")
