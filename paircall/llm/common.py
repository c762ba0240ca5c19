"""What several operators share: the shared folder, stored tables and the rules for words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space separates words; everything else belongs to one.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# For str.translate: A-Z to lower case, the white space that separates words to a plain space.
FOLD = {ord(a): b for a, b in zip(_UPPER, _LOWER, strict=True)} | {c: " " for c in range(9, 14)}


def words(text: str) -> list[str]:
    """The words of a text with A-Z in lower case; other white space than ASCII's belongs to words."""
    return [w for w in text.translate(FOLD).split(" ") if w]


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a new temporary one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and lost executors cost a re-read only.

    The files stay until the folder is cleaned, like those of checkpoint(). The shuffle files of the job are not
    needed once it has ended and are dropped at once.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """From now on, batches that go to Python hold at most `most` bytes; Spark's own bound is 64 MB."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def carried(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`row`, and `text` where the columns do not hold it: no text travels twice. `texts_of` reads either."""
    return docs.select(row_of(columns), *([] if "text" in columns else [text_or_empty().alias("text")]))


def texts_of(batch) -> list[str]:
    """The texts of an Arrow batch of `carried`, empty for null."""
    column = batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")
    return [t or "" for t in column.to_pylist()]


def row_of(columns: list[str]) -> Column:
    """The columns as one structure `row`, so that their names cannot clash with an operator's own."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in columns)).alias("row")
