"""SAM text."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.flags import parse_flag
from ..functions.tags import parse_tags
from ..operators.once import compute_once
from ..operators.sizing import broadcast_if_small
from ..schema import ALIGNMENT, FLAG_BITS
from .files import list_files, open_input


def _starts_with_digit(text: Column) -> Column:
    return (text >= "0") & (text < ":")


def _leading_int(text: Column) -> Column:
    """Digits at the start of a field as a number, else null; the pattern is tried only on odd fields."""
    number = F.coalesce(text.try_cast("int"), F.regexp_extract(text, "^[0-9]+", 0).try_cast("int"))
    return F.when(_starts_with_digit(text), number)


def _leading_signed(text: Column) -> Column:
    number = F.coalesce(text.try_cast("int"), F.regexp_extract(text, "^-?[0-9]+", 0).try_cast("int"))
    return F.when(_starts_with_digit(text) | text.startswith("-"), number)


def parse_alignments(lines: DataFrame, sample: str | Column, column: str = "value") -> DataFrame:
    """Alignment rows from text lines; header and empty lines are skipped. The sample is a name or a column of `lines`.

    Positions become 0-based, -1 where there is none. A `*` sequence or quality becomes null, and a read
    without a CIGAR counts as unmapped.
    """
    text = F.col(column)
    rows = compute_once(lines.where((text != "") & ~text.startswith("@")), {"_fields": F.split(text, "\t")})
    f = F.col("_fields")
    at = lambda i: F.get(f, F.lit(i))
    position = lambda i: F.coalesce(_leading_int(at(i)) - 1, F.lit(-1))
    flag = parse_flag(at(1))
    unmapped_bit = F.when(at(5).startswith("*"), flag.bitwiseOR(FLAG_BITS["unmapped"])).otherwise(flag)
    optional = lambda i: F.when(at(i) != "*", at(i))
    parsed = rows.select(
        (F.lit(sample) if isinstance(sample, str) else sample).alias("sample"),
        at(0).alias("qname"),
        unmapped_bit.alias("flag"),
        at(2).alias("chrom"),
        position(3).alias("pos"),
        (F.coalesce(_leading_int(at(4)), F.lit(0)).bitwiseAND(255)).alias("mapq"),
        at(5).alias("cigar"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mate_chrom"),
        position(7).alias("mate_pos"),
        F.coalesce(_leading_signed(at(8)), F.lit(0)).alias("isize"),
        optional(9).alias("seq"),
        optional(10).alias("qual"),
        F.when(F.size(f) > 11, parse_tags(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))))).alias("tags"),
    )
    return parsed.select([F.col(c.name).cast(c.dataType) for c in ALIGNMENT.fields])


def read_sam(spark: SparkSession, path: str, sample: str, contigs: DataFrame | None = None) -> DataFrame:
    """Alignment rows of SAM text; plain text is split like any Spark text input.

    With a contig dictionary, reads on a contig that it does not list become unplaced (`*`).
    """
    rows = parse_alignments(spark.read.text(path), sample)
    if contigs is None:
        return rows
    known = contigs.select("chrom", F.lit(True).alias("_known")).dropDuplicates(["chrom"])
    return (
        rows.join(broadcast_if_small(known), "chrom", "left")
        .withColumn("chrom", F.when(F.col("_known"), F.col("chrom")).otherwise("*"))
        .select(*rows.columns)
    )


def _head(path: str) -> Iterator[str]:
    """Header lines at the start of one file."""
    with open_input(path) as raw:
        stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        for line in io.TextIOWrapper(io.BufferedReader(stream), encoding="utf-8", errors="replace"):
            if not line.startswith("@"):
                return
            yield line.rstrip("\r\n")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """Header lines `file, line_no, value` of every file; reads no further than the headers."""
    files = [(name,) for name, _ in list_files(path)]
    table = spark.createDataFrame(files, "file string").repartition(max(1, min(len(files), 1000)))

    def heads(batches):
        for batch in batches:
            rows = [(name, i, line) for name in batch["file"] for i, line in enumerate(_head(name))]
            yield pd.DataFrame(rows, columns=["file", "line_no", "value"])

    return table.mapInPandas(heads, "file string, line_no int, value string")


def _field(key: str) -> Column:
    return F.nullif(F.regexp_extract("value", f"\\t{key}:([^\\t]*)", 1), F.lit(""))


def parse_contigs(header: DataFrame) -> DataFrame:
    """`chrom, length, tid` from `@SQ` lines; `tid` counts them in order of appearance."""
    squares = header.where(F.col("value").startswith("@SQ"))
    listed = squares.select("file", "line_no", _field("SN").alias("chrom"), _field("LN").try_cast("int").alias("length"))
    first = listed.groupBy("chrom").agg(
        F.min(F.struct("file", "line_no", "length")).alias("first")
    ).select("chrom", "first.*")
    # Contigs are numbered within their file, and the numbers of the files before are added, one row each.
    counts = first.groupBy("file").agg(F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("line_no", "chrom"))
    placed = first.withColumn("nth", nth).join(offsets, "file")
    return placed.select("chrom", "length", (F.col("before") + F.col("nth") - 1).cast("int").alias("tid"))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contig dictionary of SAM files. It is a header table, one row per contig."""
    return parse_contigs(read_header(spark, path))


def parse_read_groups(header: DataFrame) -> DataFrame:
    """`read_group, library` from `@RG` lines."""
    groups = header.where(F.col("value").startswith("@RG"))
    return groups.select(_field("ID").alias("read_group"), _field("LB").alias("library")).dropDuplicates(["read_group"])


def read_read_groups(spark: SparkSession, path: str) -> DataFrame:
    return parse_read_groups(read_header(spark, path))


