"""MAP-EM. Each iteration is one distributed aggregation; the driver sees at most 22 numbers of it."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.durable import durable
from ..schema import GENOTYPES, JOINT_GENOTYPES, POSTERIORS
from .density import DEFAULT_MODEL, SAMPLE_SUFFIXES, Density, marginal, model_by_name
from .scoring import posteriors

# A summation order that differs between iterations may lower the log-likelihood by this much, relatively.
NOISE = 1e-9


@dataclass(frozen=True)
class FitResult:
    params: object
    history: tuple
    converged: bool

    @property
    def iterations(self) -> int:
        return len(self.history)

    def history_table(self, spark: SparkSession) -> DataFrame:
        """`iteration, log_likelihood, change, relative_change` and the parameters after each iteration."""
        schema = T.StructType([
            T.StructField("iteration", T.IntegerType()),
            T.StructField("log_likelihood", T.DoubleType()),
            T.StructField("change", T.DoubleType()),
            T.StructField("relative_change", T.DoubleType()),
            *[T.StructField(f.name, T.ArrayType(T.DoubleType())) for f in fields(self.params)],
        ])
        rows = [
            (i, ll, change, relative, *[list(map(float, getattr(params, f.name))) for f in fields(params)])
            for i, ll, change, relative, params in self.history
        ]
        return spark.createDataFrame(rows, schema)


def training_table(sites: DataFrame, model: str | Density = DEFAULT_MODEL) -> DataFrame:
    """Site rows in the compressed form that EM iterates over."""
    return model_by_name(model).compress(sites)


def expected_statistics(training: DataFrame, params, model: str | Density = DEFAULT_MODEL) -> DataFrame:
    """One row: `n_<joint>`, `a_/b_<sample>_<genotype>` where the model has them, and `log_likelihood` of the data."""
    density = model_by_name(model)
    rows = posteriors(density.terms(training, params), params.pi, keep_lse=True)
    w = F.col("w")
    resp = [F.col(p) for p in POSTERIORS]
    sums = [F.sum(w * p).alias(f"n_{g}") for g, p in zip(JOINT_GENOTYPES, resp)]
    for s in SAMPLE_SUFFIXES:
        for i, g in enumerate(GENOTYPES):
            pair = density.allele_terms(s, g)
            if pair is not None:
                weight = w * marginal(resp, s, i)
                sums.append(F.sum(weight * pair[0]).alias(f"ea_{s}_{g}"))
                sums.append(F.sum(weight * pair[1]).alias(f"eb_{s}_{g}"))
    return rows.agg(*sums, F.sum(w * F.col("lse")).alias("log_likelihood"))


def _collected(row) -> dict[str, tuple[float, ...]]:
    values = row.asDict()
    out = {"n": tuple(values[f"n_{g}"] for g in JOINT_GENOTYPES)}
    for s in SAMPLE_SUFFIXES:
        if f"ea_{s}_{GENOTYPES[0]}" in values:
            out[f"a_{s}"] = tuple(values[f"ea_{s}_{g}"] for g in GENOTYPES)
            out[f"b_{s}"] = tuple(values[f"eb_{s}_{g}"] for g in GENOTYPES)
    return out


def fit(
    sites: DataFrame,
    model: str | Density = DEFAULT_MODEL,
    priors=None,
    params=None,
    max_iters: int = 1000,
    tolerance: float = 1e-6,
    compressed: bool = False,
) -> FitResult:
    """Fit a model to site rows, or to rows that are in the model's training form already.

    The reported log-likelihood of an iteration is the one before its update.
    """
    density = model_by_name(model)
    params = density.params_type() if params is None else params
    priors = density.params_type.priors_type() if priors is None else priors
    training = durable(sites if compressed else density.compress(sites), density.training_keys)
    history, previous, converged = [], -math.inf, False
    try:
        while True:
            row = expected_statistics(training, params, density).first()
            if row["log_likelihood"] is None:
                raise ValueError("no training sites")
            ll = params.log_prior(priors) + row["log_likelihood"]
            params = params.updated(_collected(row), priors)
            change = ll - previous
            relative = change / abs(previous) if history else math.nan
            history.append((len(history) + 1, ll, change if len(history) else math.nan, relative, params))
            if len(history) > 1 and relative < -NOISE:
                raise ArithmeticError(f"log-likelihood decreased from {previous} to {ll}")
            converged = len(history) > 1 and relative < tolerance
            if converged or len(history) >= max_iters:
                return FitResult(params, tuple(history), converged)
            previous = ll
    finally:
        training.unpersist()
