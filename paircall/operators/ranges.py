"""Binned range joins between reads and region tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regions import checked_end, overlaps, region_parts
from ..schema import BIN_SHIFT
from .once import compute_once
from .reads import with_end
from .sizing import BROADCAST_BYTES, broadcast_if_small, is_small


def resolve_regions(table: DataFrame, contigs: DataFrame, text: str = "region") -> DataFrame:
    """Add `chrom, start, end` of the region strings in `text`, with names from the dictionary's `chrom`.

    The part before the last colon is the name if a contig has it; else the whole string, if a contig is called so,
    without an interval. Neither is an error, and so is an interval that ends before it starts.
    """
    parts = compute_once(table, {"_region": region_parts(F.col(text))})
    names = contigs.select("chrom").distinct()
    named = lambda column: broadcast_if_small(names.select(F.col("chrom").alias(column)))
    found = parts.join(named("_name"), F.col("_region.chrom") == F.col("_name"), "left")
    found = found.join(named("_whole"), F.col("_region.whole") == F.col("_whole"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown contig in region: "), F.col(text))).cast("string")
    by_name = F.col("_name").isNotNull()
    start = F.when(by_name, F.col("_region.start")).otherwise(0).cast("long")
    end = F.when(by_name, checked_end(F.col("_region.start"), F.col("_region.end"), F.col(text)))
    return found.select(*table.columns, F.coalesce("_name", "_whole", unknown).alias("chrom"), start.alias("start"), end.alias("end"))


def to_bins(df: DataFrame, start: str, end: str, shift: int = BIN_SHIFT) -> DataFrame:
    """One row per bin of 2**shift positions that [start, end) touches, with the bin number in `bin`."""
    first = F.shiftright(F.col(start), shift).cast("int")
    last = F.shiftright(F.greatest(F.col(end) - 1, F.col(start)), shift).cast("int")
    return df.withColumn("bin", F.explode(F.sequence(first, last)))


def merged_pieces(regions: DataFrame, shift: int = BIN_SHIFT) -> DataFrame:
    """Regions as disjoint pieces `chrom, bin, start, end`, each inside one bin.

    Regions are cut at bin borders and reduced to the longest piece per start before any window,
    so that a window over one bin sorts at most one row per position of the bin.
    """
    width = 1 << shift
    cut = to_bins(regions.select("chrom", "start", "end").where("start < end"), "start", "end", shift).select(
        "chrom",
        "bin",
        F.greatest("start", F.col("bin") * width).cast("int").alias("start"),
        F.least("end", (F.col("bin") + 1).cast("long") * width).cast("int").alias("end"),
    )
    longest = cut.groupBy("chrom", "bin", "start").agg(F.max("end").alias("end"))

    in_bin = Window.partitionBy("chrom", "bin").orderBy("start")
    reach = F.max("end").over(in_bin.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    return (
        longest.withColumn("opens", opens)
        .withColumn("island", F.sum("opens").over(in_bin.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("chrom", "bin", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("island")
    )


def piece_index(regions: DataFrame, shift: int = BIN_SHIFT) -> DataFrame:
    """One row `chrom, bin, starts, ends, next_start` per bin from 0 to the last one that a region of the contig touches.

    `starts` and `ends` are the bin's disjoint pieces in order, at most one per position of the bin; `next_start` is where
    the first piece of a later bin begins. So the row of the bin in which something begins answers what it overlaps.
    """
    pieces = merged_pieces(regions, shift)
    held = pieces.groupBy("chrom", "bin").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_p"))
    last = held.groupBy("chrom").agg(F.max("bin").alias("_last"))
    bins = last.select("chrom", F.explode(F.sequence(F.lit(0), "_last")).alias("bin")).join(held, ["chrom", "bin"], "left")
    # Backwards, so that what a row needs is known when the window reaches it.
    later = Window.partitionBy("chrom").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<int>")
    return bins.select(
        "chrom",
        "bin",
        F.coalesce(F.col("_p.start"), none).alias("starts"),
        F.coalesce(F.col("_p.end"), none).alias("ends"),
        F.min(F.get("_p.start", F.lit(0))).over(later).alias("next_start"),
    )


def first_after(ends: Column, position: Column) -> Column:
    """Number of the first of the ascending `ends` that lies past `position`, by bisection; their count if none does."""
    halvings = F.array_repeat(F.lit(0), F.ceil(F.log2(F.size(ends) + 1)).cast("int"))
    begin = F.struct(F.lit(0).alias("low"), F.size(ends).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        past = (at["low"] >= at["high"]) | (F.get(ends, middle) > position)
        return F.struct(
            F.when(past, at["low"]).otherwise(middle + 1).alias("low"),
            F.when(past, F.least(middle, at["high"])).otherwise(at["high"]).alias("high"),
        )

    return F.aggregate(halvings, begin, halve, lambda at: at["low"])


def in_regions(reads: DataFrame, regions: DataFrame, limit: int = BROADCAST_BYTES, shift: int = BIN_SHIFT) -> DataFrame:
    """Reads that overlap at least one region, each once.

    A read meets one row of the piece index, that of the bin in which it begins, and finds its piece there by
    bisection: it is neither spread over its bins nor compared with every piece. The join is a semi join, whose
    condition sees the arrays in place, so they are not copied to each read.
    """
    index = piece_index(regions, shift)
    index = F.broadcast(index) if is_small(regions, limit) else index
    index = index.withColumnsRenamed({"chrom": "_chrom", "bin": "_bin"})
    placed = with_end(reads).withColumnRenamed("end", "_end")
    first = F.get("starts", first_after(F.col("ends"), F.col("pos")))
    overlap = F.coalesce(first, "next_start") < F.col("_end")
    same = (F.col("chrom") == F.col("_chrom")) & (F.greatest(F.shiftright("pos", shift), F.lit(0)) == F.col("_bin"))
    return placed.join(index, same & overlap, "left_semi").select(*reads.columns)


def overlap_pairs(reads: DataFrame, regions: DataFrame, limit: int = BROADCAST_BYTES, shift: int = BIN_SHIFT) -> DataFrame:
    """Every overlapping (read, region) pair; region columns are `chrom, start, end` and any others.

    Both sides are spread over bins and joined on (chrom, bin). A pair is kept only in the later of
    the two first bins, which holds both, so it comes out once without a distinct.
    """
    left = to_bins(with_end(reads).withColumnRenamed("end", "_end"), "pos", "_end", shift)
    right = regions.withColumnsRenamed({"start": "region_start", "end": "region_end"})
    right = to_bins(right.where("region_start < region_end"), "region_start", "region_end", shift)
    first_bin = F.shiftright(F.greatest("pos", "region_start"), shift)
    hit = left.join(broadcast_if_small(right, limit), ["chrom", "bin"]).where(
        overlaps(F.col("pos"), F.col("_end"), F.col("region_start"), F.col("region_end")) & (F.col("bin") == first_bin)
    )
    extra = [c for c in regions.columns if c not in ("chrom", "start", "end")]
    return hit.select(*reads.columns, "region_start", "region_end", *extra)
