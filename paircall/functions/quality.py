"""Phred qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phred_prob(quality: Column) -> Column:
    """Probability that a call with this phred quality is right."""
    return F.lit(1.0) - F.pow(F.lit(10.0), -quality / F.lit(10.0))


def mismatch_prob(prob: Column) -> Column:
    """Share of the remaining probability that falls on each of the three other bases."""
    return (F.lit(1.0) - prob) / F.lit(3.0)


def decode_quality(char: Column) -> Column:
    """Phred+33 character to number; a missing quality counts as 0."""
    return F.coalesce(F.ascii(char) - F.lit(33), F.lit(0))
