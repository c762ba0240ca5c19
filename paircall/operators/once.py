"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections use by value.

    The optimizer moves a filter below a projection by substituting the projected expressions, and so
    repeats them wherever the filter names them; for nested expressions the plan grows without bound. It does
    not move a filter below a generator, here one that makes exactly one row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
