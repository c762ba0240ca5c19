"""Arithmetic on log probabilities held in separate columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def log_sum_exp(columns: list[Column], largest: Column | None = None) -> Column:
    """ln of the sum of exponentials, shifted by the largest term; pass it if it is a column already."""
    largest = F.greatest(*columns) if largest is None else largest
    return largest + F.ln(total([F.exp(c - largest) for c in columns]))


def log_sum_exp_array(values: Column) -> Column:
    largest = F.array_max(values)
    return largest + F.ln(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - largest)))


def log_normalise_array(values: Column) -> Column:
    """Probabilities from unnormalised log probabilities."""
    lse = log_sum_exp_array(values)
    return F.transform(values, lambda x: F.exp(x - lse))


def simplex(value: Column, *group: str) -> Column:
    """Each value divided by the sum over its group."""
    return value / F.sum(value).over(Window.partitionBy(*group))
