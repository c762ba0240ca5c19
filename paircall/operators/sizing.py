"""Sizes that decide between a broadcast and a shuffle.

A size is Spark's own estimate of the optimised plan, in bytes: file sizes by the columns that are read, exact for local
rows and for what is cached, carried through the plan. Asking for it runs no job. Where a plan's size is unknown, Spark
assumes that it is huge, and the side is shuffled. Estimates of text or compressed files can be too low for what they
hold, hence a factor of safety in the limit; at run time Spark itself still chooses a broadcast for a shuffled side that
turns out to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Estimated bytes that may be broadcast. A broadcast of ten times as much is still sound on any executor.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of the rows, from the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return estimated_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a side that is estimated to be small; a larger one is left to Catalyst and AQE."""
    return F.broadcast(df) if is_small(df, limit) else df


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer partitions than the cluster has cores one per core.

    For inputs that Spark cannot split, such as gzip text or one large row group, before work that costs
    far more than moving the rows. A scan with enough partitions is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
