"""Likelihood terms of the three mixture models.

Parameters are Python floats: they enter the plan as literals, so logarithms and normalising
constants of parameters are taken once on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stirling series of ln gamma, coefficients of x^-1, x^-3, x^-5, x^-7, x^-9.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_SHIFT = 8


def log(x: float) -> float:
    return math.log(x) if x > 0 else -math.inf


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: recurrence up to x + 8, then the Stirling series."""
    product = x
    for i in range(1, _SHIFT):
        product = product * (x + F.lit(float(i)))
    y = x + F.lit(float(_SHIFT))
    inverse = F.lit(1.0) / y
    square = inverse * inverse
    series = F.lit(STIRLING[-1])
    for coefficient in reversed(STIRLING[:-1]):
        series = series * square + F.lit(coefficient)
    half_log_two_pi = 0.5 * math.log(2 * math.pi)
    return (y - F.lit(0.5)) * F.ln(y) - y + F.lit(half_log_two_pi) + series * inverse - F.ln(product)


def ln_beta(a: Column, b: Column) -> Column:
    return ln_gamma(a) + ln_gamma(b) - ln_gamma(a + b)


def binomial_loglik(a: Column, b: Column, mu: float) -> Column:
    """Binomial log-likelihood without the coefficient."""
    return a * F.lit(log(mu)) + b * F.lit(log(1 - mu))


def beta_binomial_loglik(a: Column, b: Column, alpha: float, beta: float) -> Column:
    """Beta-binomial log-likelihood without the coefficient."""
    constant = math.lgamma(alpha) + math.lgamma(beta) - math.lgamma(alpha + beta)
    return ln_beta(a + F.lit(float(alpha)), b + F.lit(float(beta))) - F.lit(constant)


def read_likelihood(q: Column, r: Column, mu: float) -> Column:
    """Likelihood of one read: base right with probability q, alignment right with probability r."""
    aligned = (F.lit(1.0) - q) * F.lit(1 - mu) + q * F.lit(mu)
    return F.lit(0.5) * (F.lit(1.0) - r) + r * aligned


def expected_a(q: Column, r: Column, mu: float) -> Column:
    """Expected reference alleles in one read."""
    return F.lit(mu) * (F.lit(0.5) + r * (q - F.lit(0.5))) / read_likelihood(q, r, mu)


def expected_b(q: Column, r: Column, mu: float) -> Column:
    """Expected variant alleles in one read."""
    return F.lit(1 - mu) * (F.lit(0.5) + r * (F.lit(0.5) - q)) / read_likelihood(q, r, mu)


def reads_loglik(reads: Column, mu: float) -> Column:
    """Log-likelihood of a site given `array<struct<q,r,n>>`."""
    return F.aggregate(
        reads, F.lit(0.0), lambda total, x: total + x["n"] * F.ln(read_likelihood(x["q"], x["r"], mu))
    )


def beta_log_density(mu: float, alpha: float, beta: float) -> float:
    """Unnormalised log density of a Beta prior."""
    return (alpha - 1) * log(mu) + (beta - 1) * log(1 - mu)


def dirichlet_log_density(x: tuple[float, ...], kappa: tuple[float, ...]) -> float:
    """Unnormalised log density of a Dirichlet prior."""
    return sum((k - 1) * log(v) for v, k in zip(x, kappa) if k != 1)
