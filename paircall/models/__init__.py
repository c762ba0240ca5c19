"""Mixture models over joint genotypes: parameters, densities, scoring and MAP-EM."""

from .density import MODELS, BetaBinomial, Binomial, Density, Quality, model_by_name
from .em import FitResult, expected_statistics, fit, training_table
from .params import BetaBinomialParams, BetaBinomialPriors, BinomialParams, BinomialPriors
from .scoring import posteriors, score

__all__ = [
    "MODELS", "Density", "Binomial", "BetaBinomial", "Quality", "model_by_name",
    "FitResult", "expected_statistics", "fit", "training_table",
    "BinomialParams", "BinomialPriors", "BetaBinomialParams", "BetaBinomialPriors",
    "posteriors", "score",
]
