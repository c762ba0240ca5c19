"""Positions lists, ready-made counts, and parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logspace import simplex
from ..models.density import DEFAULT_MODEL, Density, model_by_name
from ..schema import COUNT_TABLE, COUNTS, PARAMETER_TABLE


def parse_positions(lines: DataFrame, column: str = "value") -> DataFrame:
    """`chrom, position` (1-based) and 0-based `pos` from whitespace-separated lines, as a set."""
    parts = F.split(F.trim(F.regexp_replace(column, "\\s+", " ")), " ")
    rows = lines.select(F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).try_cast("int").alias("position"))
    return rows.where("chrom <> '' AND position IS NOT NULL").dropDuplicates().withColumn("pos", F.col("position") - 1)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return parse_positions(spark.read.text(path))


def read_counts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Ready-made counts; all four count columns must be there and are read as long."""
    reader = spark.read.option("sep", "\t").option("header", True) if fmt == "csv" else spark.read
    table = reader.format(fmt).load(path)
    missing = [c for c in COUNTS if c not in table.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return table.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in COUNT_TABLE.fields})


def read_parameter_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Long table `component, genotype, value`."""
    if fmt == "csv":
        return spark.read.option("sep", "\t").option("header", True).schema(PARAMETER_TABLE).csv(path)
    return spark.read.format(fmt).load(path).select(*PARAMETER_TABLE.names)


def normalise_weights(table: DataFrame) -> DataFrame:
    """The mixture weights of a parameter table divided by their sum; other components unchanged."""
    share = simplex(F.col("value"), "component")
    return table.withColumn("value", F.when(F.lower("component") == "pi", share).otherwise(F.col("value")))


def _rows(table: DataFrame, limit: int = 64) -> list[tuple[str, str, float]]:
    """The few rows of a parameter table; a complete one has at most 21."""
    rows = table.select(*PARAMETER_TABLE.names).take(limit)
    if len(rows) == limit:
        raise ValueError("too many rows for a parameter table")
    return [tuple(r) for r in rows]


def read_params(spark: SparkSession, path: str, model: str | Density = DEFAULT_MODEL, fmt: str = "csv"):
    """Parameters of a model; the mixture weights are normalised."""
    return model_by_name(model).params_type.from_rows(_rows(read_parameter_table(spark, path, fmt)))


def read_priors(spark: SparkSession, path: str, model: str | Density = DEFAULT_MODEL, fmt: str = "csv"):
    return model_by_name(model).params_type.priors_type.from_rows(_rows(read_parameter_table(spark, path, fmt)))
