"""Systematic sampling in genome order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1_000_000


def genome_rank(sites: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add `rank`, the 1-based place of each site in (chrom, pos) order, one site per position.

    No window runs over all rows: a site is ranked within its block of positions, and blocks, one row each, are added
    up in order. The sites are read twice, for their places and for the blocks' counts.
    """
    placed = sites.withColumn("_block", F.floor(F.col("pos") / block).cast("int"))
    in_block = Window.partitionBy("chrom", "_block").orderBy("pos")
    blocks = placed.groupBy("chrom", "_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("chrom", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("chrom", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.withColumn("_row", F.row_number().over(in_block))
        .join(offsets, ["chrom", "_block"])
        .withColumn("rank", F.col("_row") + F.col("_offset"))
        .drop("_block", "_row", "_offset")
    )


def every_kth_site(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The rows of every k-th site, of a table with several rows per site. The rows are read twice."""
    if k <= 1:
        return rows
    return rows.join(every_kth(rows.select("chrom", "pos").distinct(), k, block), ["chrom", "pos"], "left_semi")


def every_kth(sites: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Every k-th site in genome order, the k-th first."""
    if k <= 1:
        return sites
    return genome_rank(sites, block).where(F.col("rank") % k == 0).drop("rank")
