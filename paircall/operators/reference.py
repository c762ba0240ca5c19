"""Reference bases from a chunk table `chrom, chunk_id, chunk_start, seq, width`.

The width of the chunks travels with the table, so that every lookup divides by the right one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import normalise_bases
from ..schema import CHUNK
from .ranges import resolve_regions
from .sizing import broadcast_if_small

# Chunks that are gathered at once when an interval is put together.
_GATHER = 1024
# Intervals that meet one copy of a chunk.
_SHARE = 10_000
_LARGEST = (1 << 31) - 1


def last_chunks(chunks: DataFrame) -> DataFrame:
    """`chrom, _last, _width`: the number of the last chunk of every contig. No sequence is read."""
    return chunks.groupBy("chrom").agg(F.max("chunk_id").alias("_last"), F.max("width").alias("_width"))


def _lookup(chunks: DataFrame, *renamed: Column) -> DataFrame:
    """Chunk rows as a join needs them; fails where a chunk does not begin at its number times the width."""
    sound = F.col("chunk_start") == F.col("chunk_id").cast("long") * F.col("width")
    broken = F.raise_error(F.concat(F.lit("chunk table with another width: "), "chrom", F.lit(" "), F.col("chunk_start").cast("string")))
    return chunks.select("chrom", *renamed, "chunk_start", F.when(sound, F.col("seq")).otherwise(broken.cast("string")).alias("_seq"))


def with_reference_base(sites: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the upper-case `ref_base`; past the end of a contig its last base, for an unknown contig an error.

    Sites meet the chunk that holds them, whose number follows from the width the table carries; those past the end meet
    the last chunk. The sequence is read once: chunk numbers tell where a contig ends. No base is spread to a row of its
    own, and how the join runs (a small table is broadcast) is left to Spark: there is one way to look up. A chunk that
    is missing or too short is an error.
    """
    placed = sites.join(broadcast_if_small(last_chunks(chunks)), "chrom", "left")
    placed = placed.withColumn("_chunk", F.least(F.floor(F.col("pos") / F.col("_width")), "_last").cast("int"))
    found = placed.join(_lookup(chunks, F.col("chunk_id").alias("_chunk")), ["chrom", "_chunk"], "left")
    offset, length = F.col("pos") - F.col("chunk_start") + 1, F.length("_seq")
    held = (offset <= length) | (F.col("_chunk") == F.col("_last"))
    base = F.when(held, F.upper(F.substring("_seq", F.least(offset, length).cast("int"), F.lit(1))))
    what = F.when(F.col("_width").isNull(), "contig not in the reference: ").otherwise("no such chunk in the reference: ")
    missing = F.raise_error(F.concat(what, "chrom", F.lit(" "), F.col("pos").cast("string"))).cast("string")
    return found.withColumn("ref_base", F.coalesce(base, missing)).select(*sites.columns, "ref_base")


def _shared_out(spread: DataFrame, chunks: DataFrame, share: int) -> DataFrame:
    """Interval rows with their chunk. A chunk that more than `share` of them want is dealt to groups of that size.

    Only such chunks are copied, and their list has at most one row for every `share` interval rows.
    """
    many = spread.groupBy("chrom", "chunk_id").agg(F.count("*").alias("n")).where(F.col("n") > share)
    many = many.select("chrom", "chunk_id", F.ceil(F.col("n") / share).cast("int").alias("_parts"))
    own = F.coalesce(F.pmod(F.xxhash64("_start", "_end"), F.col("_parts")), F.lit(0)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))
    left = spread.join(many, ["chrom", "chunk_id"], "left").withColumn("_part", own).drop("_parts")
    right = _lookup(chunks, F.col("chunk_id")).join(many, ["chrom", "chunk_id"], "left").withColumn("_part", every).drop("_parts")
    return left.join(right, ["chrom", "chunk_id", "_part"], "left")


def fetch_intervals(intervals: DataFrame, chunks: DataFrame, share: int = _SHARE) -> DataFrame:
    """Add `sequence`, the reference over [start, end) clipped to the contig, to every interval row.

    A null `end` reaches to the end of the contig. Equal intervals are put together once and all get it; an unknown
    contig is an error. Any number of intervals may lie over one locus.
    """
    unknown = F.raise_error(F.concat(F.lit("contig not in the reference: "), F.col("chrom"))).cast("long")
    # Up to where chunks reach; the pieces end where the sequence does.
    limit = F.least(F.coalesce((F.col("_last").cast("long") + 1) * F.col("_width"), unknown), F.lit(_LARGEST))
    clipped = intervals.join(broadcast_if_small(last_chunks(chunks)), "chrom", "left").select(
        *intervals.columns,
        "_width",
        F.least(F.greatest(F.coalesce("end", limit), F.lit(0)), limit).cast("int").alias("_end"),
        F.least(F.greatest("start", F.lit(0)), F.coalesce("end", limit), limit).cast("int").alias("_start"),
    )
    clipped = clipped.withColumn("_start", F.greatest("_start", F.lit(0)))
    keys = ["chrom", "_start", "_end"]
    last = F.greatest(F.col("_end") - 1, F.col("_start"))
    number = lambda at: F.floor(at / F.col("_width")).cast("int")
    spread = clipped.select(*keys, "_width").distinct()
    spread = spread.select(*keys, F.explode(F.sequence(number(F.col("_start")), number(last))).alias("chunk_id"))
    pieces = _shared_out(spread, chunks, share)
    first = F.greatest(F.col("_start"), F.col("chunk_start"))
    until = F.least(F.col("_end"), F.col("chunk_start") + F.length("_seq"))
    part = F.when(until > first, F.substring("_seq", first - F.col("chunk_start") + 1, until - first)).otherwise("")
    # Two steps, so that the pieces of one long interval are gathered by many tasks first.
    block = F.floor(F.col("chunk_id") / _GATHER).cast("int")
    parts = pieces.select(*keys, block.alias("_block"), F.struct(F.col("chunk_id").alias("at"), part.alias("text")).alias("_p"))
    blocks = parts.groupBy(*keys, "_block").agg(_joined("_p").alias("text"))
    whole = (
        blocks.select(*keys, F.struct(F.col("_block").alias("at"), "text").alias("_p"))
        .groupBy(*keys)
        .agg(_joined("_p").alias("sequence"))
    )
    return clipped.join(whole, keys).select(*intervals.columns, "sequence")


def fetch_region(chunks: DataFrame, region: str) -> DataFrame:
    """`fetch_intervals` for one 1-based `chr:beg-end` string, whose name is one of the chunk table's contigs."""
    one = chunks.sparkSession.range(1).select(F.lit(region).alias("region"))
    return fetch_intervals(resolve_regions(one, chunks).drop("region"), chunks)


def _joined(column: str) -> Column:
    """The `text` of all structs of a group in the order of `at`."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda p: p["text"]), "")


def chunk_table(bases: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunk table of a reference given per position, `chrom, pos, ref_base` without gaps."""
    pieces = bases.select(
        "chrom",
        F.floor(F.col("pos") / chunk).cast("int").alias("chunk_id"),
        F.struct(F.col("pos").cast("int").alias("at"), F.col("ref_base").alias("text")).alias("b"),
    )
    return (
        pieces.groupBy("chrom", "chunk_id")
        .agg(F.min("b.at").alias("chunk_start"), _joined("b").alias("seq"))
        .select("chrom", "chunk_id", "chunk_start", normalise_bases(F.col("seq")).alias("seq"), F.lit(chunk).alias("width"))
    )
