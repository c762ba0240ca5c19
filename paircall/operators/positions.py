"""Restriction to a list of positions `chrom, pos` (0-based)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import in_regions
from .sizing import BROADCAST_BYTES, broadcast_if_small


def position_keys(positions: DataFrame) -> DataFrame:
    """0-based keys of a list read with 1-based `position`."""
    keys = positions if "pos" in positions.columns else positions.withColumn("pos", F.col("position") - 1)
    return keys.select("chrom", F.col("pos").cast("int").alias("pos"))


def at_positions(df: DataFrame, positions: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows whose (chrom, pos) is listed. A list of few bytes is broadcast; a larger one is shuffled."""
    return df.join(broadcast_if_small(position_keys(positions), limit), ["chrom", "pos"], "left_semi")


def reads_near(reads: DataFrame, positions: DataFrame) -> DataFrame:
    """Reads that cover at least one listed position; the rest need no expansion."""
    keys = position_keys(positions)
    return in_regions(reads, keys.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")))
