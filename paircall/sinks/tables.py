"""Result, count, parameter and history tables. Text output is a folder of tab-separated parts with a header each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COUNTS, PARAMETER_TABLE, POSTERIORS, RESULT_COLUMNS


def results_table(scored: DataFrame) -> DataFrame:
    """The 17 result columns, 1-based position, in full precision."""
    renamed = {
        "chrom": F.col("chrom"),
        "position": F.col("pos") + 1,
        "ref_base": F.col("ref_base"),
        "var_base": F.col("var_base"),
        "normal_counts_a": F.col("a_N"),
        "normal_counts_b": F.col("b_N"),
        "tumour_counts_a": F.col("a_T"),
        "tumour_counts_b": F.col("b_T"),
    } | {p: F.col(p) for p in POSTERIORS}
    return scored.select(*[renamed[c].alias(c) for c in RESULT_COLUMNS])


def results_text(scored: DataFrame) -> DataFrame:
    """The result columns as text writes them: probabilities with four decimals."""
    return results_table(scored).withColumns({p: F.col(p).cast("decimal(5,4)").cast("string") for p in POSTERIORS})


def in_order(df: DataFrame, position: str = "pos") -> DataFrame:
    """Rows by contig name and position, range-partitioned."""
    return df.orderBy("chrom", position)


def _write_text(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_results(scored: DataFrame, path: str, fmt: str = "tsv", mode: str = "errorifexists") -> None:
    """Ordered results as tab-separated text, or in full precision in any other Spark format."""
    if fmt == "tsv":
        _write_text(in_order(results_text(scored), "position"), path, mode)
    else:
        in_order(results_table(scored), "position").write.mode(mode).format(fmt).save(path)


def counts_table(sites: DataFrame) -> DataFrame:
    """The 8 count columns with a 1-based position."""
    return sites.select("chrom", (F.col("pos") + 1).alias("position"), "ref_base", "var_base", *COUNTS)


def write_counts(sites: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _write_text(in_order(counts_table(sites), "position"), path, mode)


def params_table(spark: SparkSession, params) -> DataFrame:
    """Parameters or priors as rows `component, genotype, value`; at most 21."""
    return spark.createDataFrame(params.to_rows(), PARAMETER_TABLE).coalesce(1)


def write_params(spark: SparkSession, params, path: str, mode: str = "errorifexists") -> None:
    _write_text(params_table(spark, params), path, mode)


def write_history(spark: SparkSession, result, path: str, mode: str = "errorifexists") -> None:
    """Training history as Parquet."""
    result.history_table(spark).coalesce(1).write.mode(mode).parquet(path)
