"""Line de-duplication by overlapping windows of three lines.

Every three consecutive lines of a text form a window. Of the windows with equal text, over all documents, the first
(smallest doc_id, then digest of the text, then line) stays; the lines of all others are removed. Overlapping windows
are merged: a line goes if any later occurrence covers it. Windows are judged on the input, not on what is left.

Windows travel as 128-bit digests. First occurrences are an aggregation with partial results before the shuffle, so a
window that occurs in very many documents costs one row per task. They are stored, and windows are joined with them:
both sides of that join are plain exchanges, whose skewed partitions Spark splits.

Defined results: a text is split at line feeds only; a null text has no lines, an empty one a single empty line.
Texts of fewer than three lines have no window and stay whole. Windows of blank lines only are left alone. Rows that
repeat doc_id and text are one document and get equal results; equal doc_ids with different texts are documents of
their own. An empty table gives an empty result. Only `doc_id` and `text` are read; other columns travel in a struct.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import row_of, stored

LINES = 3
_KEY = ("doc_id", "digest")


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, line, window): one row per window."""
    lines = F.split(F.col("text"), "\n")
    joined = F.transform(
        F.sequence(F.lit(0), F.size("lines") - LINES),
        lambda i: F.concat_ws("\n", F.slice("lines", i + 1, F.lit(LINES))),
    )
    keyed = F.transform(joined, lambda w: F.when(F.length(F.trim(F.translate(w, "\n", " "))) > 0, F.unhex(F.md5(w))))
    return (
        docs.where("text IS NOT NULL")
        .select("doc_id", F.md5("text").alias("digest"), lines.alias("lines"))
        .where(F.size("lines") >= LINES)
        .select("doc_id", "digest", F.posexplode(keyed).alias("line", "window"))
        .where("window IS NOT NULL")
    )


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, lines): first lines of the windows that occurred before; only documents that have any."""
    windows = _windows(docs)
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "digest", "line")
    firsts = windows.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    firsts = stored(firsts.select("window", "first"), "firsts")
    later = windows.join(firsts, "window").where(place > F.col("first"))
    return later.groupBy(*_KEY).agg(F.collect_set("line").alias("lines"))


def deduplicate(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per document: `row` (a struct of `columns`, by default doc_id), kept, n_lines, n_removed, spans.

    `kept` is the text that remains, `spans` are the removed runs of lines (first, last).
    """
    rows = docs.select(row_of(columns or ["doc_id"]), "doc_id", "text", F.md5("text").alias("digest"))
    found = repeated(docs).withColumnsRenamed({"doc_id": "found_id", "digest": "found_digest"})
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("digest") == F.col("found_digest"))
    rows = rows.join(found, same, "left").select("row", "text", "lines")
    shape = rows.select("row").schema.add("kept", "string").add("n_lines", "integer").add("n_removed", "integer")
    shape = shape.add("spans", ArrayType(StructType().add("first", "integer").add("last", "integer")))

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            kept, lines, removed, spans = [], [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                parts = [] if text is None else text.split("\n")
                gone = covered(len(parts), starts or [])
                kept.append(None if text is None else "\n".join(p for p, g in zip(parts, gone, strict=True) if not g))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                lines.append(len(parts))
                removed.append(int(gone.sum()))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            made = [pa.array(kept, pa.string()), pa.array(lines, pa.int32()), pa.array(removed, pa.int32()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", "kept", "n_lines", "n_removed", "spans"])

    return rows.mapInArrow(task, shape)


def covered(n: int, starts: list[int]) -> np.ndarray:
    """Which of n lines the windows cover."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, np.array(starts, dtype=np.int64), 1)
    np.add.at(edges, np.array(starts, dtype=np.int64) + LINES, -1)
    return np.cumsum(edges)[:n] > 0


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = deduplicate(docs)
    return found.select("row.doc_id", "n_lines", "n_removed", F.size("spans").alias("n_spans"), F.md5(F.coalesce("kept", F.lit(""))).alias("kept_md5"))


OP10_SQL = """
WITH l AS (
  SELECT doc_id, coalesce(md5(text), '') AS digest, unnest(range(len(string_split(text, chr(10))))) AS line,
         unnest(string_split(text, chr(10))) AS words
  FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, digest, line,
         words || chr(10) || lead(words, 1) OVER d || chr(10) || lead(words, 2) OVER d AS words
  FROM l WINDOW d AS (PARTITION BY doc_id, digest ORDER BY line)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id NULLS FIRST, digest, line) AS nth
  FROM w WHERE words IS NOT NULL AND trim(replace(words, chr(10), ' ')) <> ''),
g AS (SELECT DISTINCT doc_id, digest, line + k AS line FROM r, (VALUES (0), (1), (2)) v(k) WHERE nth > 1),
m AS (
  SELECT l.*, g.line IS NOT NULL AS gone,
         g.line IS NOT NULL AND lag(g.line) OVER (PARTITION BY l.doc_id, l.digest ORDER BY l.line) IS NULL AS begins
  FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.digest = g.digest AND l.line = g.line),
k AS (
  SELECT doc_id, digest, count(*)::INTEGER AS n_lines, count_if(gone)::INTEGER AS n_removed, count_if(begins)::INTEGER AS n_spans,
         md5(coalesce(string_agg(words, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_md5
  FROM m GROUP BY doc_id, digest)
SELECT d.doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed,
       coalesce(n_spans, 0)::INTEGER AS n_spans, coalesce(kept_md5, md5('')) AS kept_md5
FROM documents d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND md5(d.text) = k.digest
"""
