"""Tables that are read many times."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def _checkpoint_folder(spark: SparkSession) -> str | None:
    """The folder that the session or the cluster names, or none. It has to be one that all executors share."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Compute once, write to the checkpoint folder, and keep in memory or on disk for repeated reads.

    Blocks lost with an executor are read again from the checkpoint instead of from the alignments. The kept
    rows are partitioned by `keys`, so that repeated aggregations by them need no shuffle. The caller
    unpersists; the files go with Spark's cleaner (spark.cleaner.referenceTracking.cleanCheckpoints). Without a
    checkpoint folder (spark.checkpoint.dir) the table is only cached.
    """
    if _checkpoint_folder(df.sparkSession) is not None:
        df = df.checkpoint(eager=True)
    return (df.repartition(*keys) if keys else df).persist(StorageLevel.MEMORY_AND_DISK)
