"""Operators on alignment rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions.flags import flag_letters, has_bits
from ..functions.regions import parse_region
from ..functions.tags import tag_string
from ..schema import DEFAULT_MASK, FLAG_BITS
from .once import compute_once
from .sizing import broadcast_if_small


class BadRecords(ValueError):
    """Raised by strict validation."""


def filter_flags(reads: DataFrame, mask: int = DEFAULT_MASK) -> DataFrame:
    """Drop reads with any masked flag bit (unmapped reads always go) and reads without a contig."""
    return reads.where(~has_bits(F.col("flag"), mask | FLAG_BITS["unmapped"]) & (F.col("chrom") != "*"))


def on_chromosome(df: DataFrame, chrom: str | None) -> DataFrame:
    return df if chrom is None else df.where(F.col("chrom") == chrom)


def with_end(reads: DataFrame) -> DataFrame:
    """Add `end`, the first reference position after the alignment (`pos` + 1 without a CIGAR)."""
    pos, cigar = F.col("pos"), F.col("cigar")
    return compute_once(reads, {"end": F.when(cigar == "*", pos + 1).otherwise(cg.reference_end(pos, cigar))})


def in_region(reads: DataFrame, chrom: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Whole reads that overlap [start, end) of one contig.

    The conditions on `chrom` and `pos` are plain columns, so they reach the scan.
    """
    hit = reads.where(F.col("chrom") == chrom)
    if end is not None:
        hit = hit.where(F.col("pos") < end)
    if start > 0:
        hit = with_end(hit).where(F.col("end") > start).select(*reads.columns)
    return hit


def in_region_string(reads: DataFrame, region: str) -> DataFrame:
    """`in_region` for a 1-based `chr:beg-end` string."""
    parsed = reads.sparkSession.range(1).select(parse_region(F.lit(region)).alias("r")).select("r.*").first()
    return in_region(reads, parsed["chrom"], parsed["start"], parsed["end"])


def decode_flags(reads: DataFrame) -> DataFrame:
    """Add one boolean per flag bit (`is_paired`, `is_reverse`, ...) and `flag_letters`."""
    return reads.withColumns(
        {f"is_{name}": has_bits(F.col("flag"), bit) for name, bit in FLAG_BITS.items()}
        | {"flag_letters": flag_letters(F.col("flag"))}
    )


def record_error() -> Column:
    """First problem of an alignment row, or null."""
    cigar, seq, qual = F.col("cigar"), F.col("seq"), F.col("qual")
    return (
        F.when(F.col("qname").isNull() | (F.length("qname") == 0), "missing read name")
        .when(F.col("qname").contains("\x00"), "read name holds a NUL")
        .when(cigar.isNull() | ~cigar.rlike("^(\\*|[0-9A-Za-z=]+)$"), "invalid CIGAR character")
        .when(~cg.is_valid_cigar(cigar), "invalid CIGAR operation")
        .when(
            (cigar != "*") & seq.isNotNull() & (cg.query_length(cigar) != F.length(seq)),
            "CIGAR and sequence length are inconsistent",
        )
        .when(
            qual.isNotNull() & (F.length(qual) != F.coalesce(F.length(seq), F.lit(0))),
            "sequence and quality are inconsistent",
        )
    )


def validate(reads: DataFrame) -> DataFrame:
    """Add `error`; null for a sound record."""
    return reads.withColumn("error", record_error())


def split_valid(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound records and bad records."""
    checked = validate(reads)
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def strict(reads: DataFrame) -> DataFrame:
    """The same records; a job over them fails at the first bad one."""
    problem = record_error()
    message = F.concat(F.lit("bad record "), F.coalesce("qname", F.lit("?")), F.lit(": "), problem)
    return reads.where(F.when(problem.isNull(), True).otherwise(F.raise_error(message).cast("boolean")))


def with_library(reads: DataFrame, read_groups: DataFrame) -> DataFrame:
    """Add `library` through the RG tag; reads of unknown groups get null."""
    groups = read_groups.select(F.col("read_group").alias("_rg"), "library").dropDuplicates(["_rg"])
    return (
        reads.withColumn("_rg", tag_string(F.col("tags"), "RG"))
        .join(broadcast_if_small(groups), "_rg", "left")
        .drop("_rg")
    )


def contig_stats(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Mapped and unmapped reads per contig of the dictionary, and a `*` row for reads without one."""
    unmapped = has_bits(F.col("flag"), FLAG_BITS["unmapped"])
    counted = reads.groupBy("chrom").agg(
        F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"), F.count("*").alias("reads")
    )
    dictionary = contigs.select("chrom", F.col("length").cast("long").alias("length"))
    star = counted.where(F.col("chrom") == "*").select(
        "chrom", F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("mapped"), F.col("reads").alias("unmapped")
    )
    zero = F.lit(0).cast("long")
    per_contig = dictionary.join(counted, "chrom", "left").select(
        "chrom",
        "length",
        F.coalesce("mapped", zero).alias("mapped"),
        F.coalesce("unmapped", zero).alias("unmapped"),
    )
    return per_contig.unionByName(star)


def shared_contigs(*tables: DataFrame) -> DataFrame:
    """Contigs that every table has."""
    return reduce(lambda a, b: a.intersect(b), [t.select("chrom") for t in tables])


def require_contig(contigs: DataFrame, chrom: str) -> None:
    """Raise unless the contig is listed."""
    if not contigs.where(F.col("chrom") == chrom).take(1):
        raise ValueError(f"unknown contig: {chrom}")
