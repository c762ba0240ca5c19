"""CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIGAR_PATTERN = "([0-9]+)([MIDNSHP=Xmidnshpx])"
ONE_MATCH = "^[0-9]+[MX=]$"


def parse_cigar(cigar: Column) -> Column:
    """`array<struct<len:int,op:string>>`; empty for `*`."""
    lens = F.regexp_extract_all(cigar, F.lit(CIGAR_PATTERN), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(CIGAR_PATTERN), F.lit(2))
    return F.zip_with(
        lens, ops, lambda n, op: F.struct(n.try_cast("int").alias("len"), F.upper(op).alias("op"))
    )


def _total(ops: Column, consuming: str) -> Column:
    return F.aggregate(
        ops,
        F.lit(0),
        lambda total, item: total + F.when(item["op"].isin(*consuming), item["len"]).otherwise(0),
    )


def _total_of(cigar: Column, consuming: str) -> Column:
    single = F.regexp_extract(cigar, "^([0-9]+)", 1).try_cast("int")
    return F.when(cigar.rlike(ONE_MATCH), single).otherwise(_total(parse_cigar(cigar), consuming))


def reference_length(cigar: Column) -> Column:
    """Reference positions covered by the alignment."""
    return _total_of(cigar, "MDN=X")


def query_length(cigar: Column) -> Column:
    """Read bases that the CIGAR accounts for."""
    return _total_of(cigar, "MIS=X")


def reference_end(pos: Column, cigar: Column) -> Column:
    """First reference position after the alignment."""
    return pos + reference_length(cigar)


def is_valid_cigar(cigar: Column) -> Column:
    return cigar.rlike(f"^(\\*|({CIGAR_PATTERN})+)$")
