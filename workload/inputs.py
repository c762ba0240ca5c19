"""Operator inputs derived from the driver's tables.

A line item is a base observation, or an alignment in SAM text, of one of two samples; a part is a
reference position; suppliers give regions and read groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paircall.operators.once import compute_once
from paircall.operators.reference import chunk_table
from paircall.operators.sizing import spread
from paircall.sources.sam import parse_alignments

CONTIGS = ("A", "N", "R")
# Fixed values of the mapping: CIGAR and read length by line number, flag by supplier.
CIGARS = (("10M", 10), ("10M", 10), ("4M1I6M", 11), ("2M1D7M", 9), ("3S7M", 10), ("2M3N5M", 7), ("5=1X4=", 10))
FLAGS = (4, 256, 512, 1024, 16, 99, 147, 0, 83, 163)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the line items that stand for observations and alignments."""
    columns = ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "returnflag", "linestatus")
    return spread(table(spark, sf_dir, "lineitem").select(*[f"l_{c}" for c in columns]))


def choose(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sample() -> Column:
    return F.when(F.col("l_linestatus") == "F", "normal").otherwise("tumour")


def _mapq() -> Column:
    return F.floor("l_extendedprice").cast("int") % 61


def reference_letter() -> Column:
    return F.substring(F.lit("ACGT"), (1 + F.col("p_size") % 4).cast("int"), F.lit(1))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sample, chrom, pos, ref_base, base, bq, mq`."""
    part = table(spark, sf_dir, "part").select("p_partkey", reference_letter().alias("ref_base"))
    pairs = items(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    other = F.substring(F.lit("ACGT"), (1 + F.col("l_suppkey") % 4).cast("int"), F.lit(1))
    base = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_suppkey") % 10 < 6, F.col("ref_base")).otherwise(other)
    return pairs.select(
        _sample().alias("sample"),
        F.col("l_returnflag").alias("chrom"),
        F.col("l_partkey").cast("int").alias("pos"),
        "ref_base",
        base.alias("base"),
        F.col("l_quantity").cast("int").alias("bq"),
        _mapq().alias("mq"),
    )


def alignment_lines(spark: SparkSession, sf_dir: str, sample: str | None = None) -> DataFrame:
    """SAM text lines of one sample or of both, with the sample's name beside each."""
    kind = F.col("l_linenumber") - 1
    length = choose(kind, [n for _, n in CIGARS])
    start = lambda column, n: (1 + F.col(column).cast("int") % n).cast("int")
    fields = [
        F.concat_ws(".", F.col("l_orderkey"), F.col("l_linenumber")),
        choose(F.col("l_suppkey") % 10, FLAGS),
        F.col("l_returnflag"),
        F.col("l_partkey") + 1,
        _mapq(),
        choose(kind, [c for c, _ in CIGARS]),
        F.lit("="),
        F.col("l_partkey") + 200,
        F.col("l_suppkey") - 50,
        F.substring(F.repeat(F.lit("ACgT"), 4), start("l_suppkey", 4), length),
        F.substring(F.repeat(F.lit("5?I!+"), 4), start("l_quantity", 5), length),
        F.concat(F.lit("NM:i:"), F.col("l_quantity").cast("int")),
        F.when(F.col("l_suppkey") % 5 == 0, "RG:Z:none").otherwise(F.concat(F.lit("RG:Z:rg"), F.col("l_suppkey"))),
        F.concat(F.lit("XT:A:"), F.col("l_returnflag")),
        F.concat(F.lit("XF:f:"), F.col("l_linenumber").cast("string"), F.lit(".5")),
    ]
    chosen = items(spark, sf_dir)
    if sample:
        chosen = chosen.where(_sample() == sample)
    line = F.concat_ws("\t", *[f.cast("string") for f in fields])
    return compute_once(chosen, {"value": line}).select(_sample().alias("sample"), "value")


def reads(spark: SparkSession, sf_dir: str, sample: str | None = None) -> DataFrame:
    """Alignment rows of one sample or of both."""
    return parse_alignments(alignment_lines(spark, sf_dir, sample), F.col("sample"))


def reference_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`chrom, pos, ref_base`, the same sequence on each contig."""
    contigs = F.explode(F.array(*map(F.lit, CONTIGS)))
    return table(spark, sf_dir, "part").select(
        contigs.alias("chrom"), F.col("p_partkey").cast("int").alias("pos"), reference_letter().alias("ref_base")
    )


def reference_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_table(reference_bases(spark, sf_dir))


def position_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions list in text, 1-based."""
    contigs = F.explode(F.array(F.lit("A"), F.lit("R")))
    parts = table(spark, sf_dir, "part").where("p_size <= 10")
    return parts.select("p_partkey", contigs.alias("chrom")).select(
        F.concat_ws(" ", "chrom", (F.col("p_partkey") + 1).cast("string")).alias("value")
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`chrom, start, end, region`; some regions overlap."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        choose(key % 3, CONTIGS).alias("chrom"),
        (key * 19).cast("int").alias("start"),
        (key * 19 + 5 + F.col("s_nationkey") * 4).cast("int").alias("end"),
        F.col("s_name").alias("region"),
    )


def header_lines(spark: SparkSession, sf_dir: str, sample: str | None = None) -> DataFrame:
    """`@SQ` lines of the contigs that a sample has reads on, and `@RG` lines of the suppliers."""
    lines = table(spark, sf_dir, "lineitem")
    if sample:
        lines = lines.where(_sample() == sample)
    squares = lines.groupBy("l_returnflag").agg(F.max("l_partkey").alias("last")).select(
        F.ascii("l_returnflag").alias("line_no"),
        F.concat(F.lit("@SQ\tSN:"), "l_returnflag", F.lit("\tLN:"), (F.col("last") + 1).cast("string")).alias("value"),
    )
    groups = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1000).cast("int").alias("line_no"),
        F.concat(F.lit("@RG\tID:rg"), "s_suppkey", F.lit("\tLB:lib"), "s_nationkey").alias("value"),
    )
    return squares.unionByName(groups).select(F.lit("header").alias("file"), "line_no", "value")
