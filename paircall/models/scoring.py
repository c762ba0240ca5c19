"""Posterior probabilities of the nine joint genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.likelihood import log
from ..functions.logspace import log_sum_exp
from ..operators.once import compute_once
from ..schema import GENOTYPES, JOINT_GENOTYPES, POSTERIORS
from .density import DEFAULT_MODEL, LOGLIKS, Density, loglik_name, model_by_name


def joint_loglik(pi: tuple[float, ...]) -> list[Column]:
    """ln weight + normal + tumour log-likelihood for each joint genotype, from the six `l_*` columns."""
    pairs = [(n, t) for n in GENOTYPES for t in GENOTYPES]
    return [
        F.lit(log(weight)) + F.col(loglik_name("N", n)) + F.col(loglik_name("T", t))
        for weight, (n, t) in zip(pi, pairs)
    ]


def posteriors(with_loglik: DataFrame, pi: tuple[float, ...], keep_lse: bool = False) -> DataFrame:
    """Replace the six `l_*` columns by the nine `p_*` columns (and `lse`, the log-likelihood of the site)."""
    joint = {f"_j_{g}": c for g, c in zip(JOINT_GENOTYPES, joint_loglik(pi))}
    rows = with_loglik.withColumns(joint).withColumn("_largest", F.greatest(*joint))
    rows = compute_once(rows, {"lse": log_sum_exp([F.col(c) for c in joint], F.col("_largest"))}).drop("_largest")
    rows = rows.withColumns({p: F.exp(F.col(c) - F.col("lse")) for p, c in zip(POSTERIORS, joint)})
    return rows.drop(*joint, *LOGLIKS, *([] if keep_lse else ["lse"]))


def score(sites: DataFrame, params=None, model: str | Density = DEFAULT_MODEL) -> DataFrame:
    """Add `p_AA_AA ... p_BB_BB` to site rows; row by row, so `sites` may be a stream."""
    density = model_by_name(model)
    params = density.params_type() if params is None else params
    return posteriors(density.with_loglik(sites, params), params.pi)
