"""Parameters and priors: small frozen values on the driver, stored as long tables."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import ClassVar

from ..functions.likelihood import beta_log_density, dirichlet_log_density
from ..schema import GENOTYPES, JOINT_GENOTYPES

# ---- fixed values: defaults ---------------------------------------------------------------------
DEFAULT_PI = (1e6, 1e3, 1e3, 1e3, 1e4, 1e3, 1e1, 1e1, 1e4)
DEFAULT_MU = (0.99, 0.5, 0.01)
DEFAULT_ALPHA = (1000.0, 500.0, 1.0)
DEFAULT_BETA = (1.0, 500.0, 1000.0)
DEFAULT_PI_PRIOR = (2.0,) * 9
DEFAULT_MU_PRIOR_ALPHA = (1000.0, 500.0, 2.0)
DEFAULT_MU_PRIOR_BETA = (2.0, 500.0, 1000.0)
# -------------------------------------------------------------------------------------------------


def _simplex(values: tuple[float, ...]) -> tuple[float, ...]:
    whole = sum(values)
    if whole <= 0 or min(values) < 0:
        raise ValueError("mixture weights must not be negative and not all zero")
    return tuple(float(v) / whole for v in values)


class _Table:
    """Conversion to and from `(component, genotype, value)` rows; genotype names ignore case."""

    def to_rows(self) -> list[tuple[str, str, float]]:
        rows = []
        for f in fields(self):
            values = getattr(self, f.name)
            names = JOINT_GENOTYPES if len(values) == 9 else GENOTYPES
            rows += [(f.name, g, float(v)) for g, v in zip(names, values)]
        return rows

    @classmethod
    def from_rows(cls, rows):
        found = {(component.lower(), genotype.upper()): float(value) for component, genotype, value in rows}
        values = {}
        for f in fields(cls):
            names = JOINT_GENOTYPES if f.name == "pi" else GENOTYPES
            missing = [g for g in names if (f.name.lower(), g) not in found]
            if missing:
                raise ValueError(f"{cls.__name__}: no value for {f.name} of {', '.join(missing)}")
            values[f.name] = tuple(found[f.name.lower(), g] for g in names)
        return cls(**values)


@dataclass(frozen=True)
class BinomialPriors(_Table):
    """Dirichlet prior on the mixture weights and Beta priors on mu."""

    pi: tuple[float, ...] = DEFAULT_PI_PRIOR
    mu_N_alpha: tuple[float, ...] = DEFAULT_MU_PRIOR_ALPHA
    mu_N_beta: tuple[float, ...] = DEFAULT_MU_PRIOR_BETA
    mu_T_alpha: tuple[float, ...] = DEFAULT_MU_PRIOR_ALPHA
    mu_T_beta: tuple[float, ...] = DEFAULT_MU_PRIOR_BETA

    def __post_init__(self):
        if min(self.pi) < 1:
            raise ValueError("Dirichlet prior values must be at least 1")


@dataclass(frozen=True)
class BetaBinomialPriors(_Table):
    """Dirichlet prior on the mixture weights."""

    pi: tuple[float, ...] = DEFAULT_PI_PRIOR

    def __post_init__(self):
        if min(self.pi) < 1:
            raise ValueError("Dirichlet prior values must be at least 1")


def _updated_pi(n, prior) -> tuple[float, ...]:
    return _simplex(tuple(max(count + kappa - 1, 0.0) for count, kappa in zip(n, prior)))


def _updated_mu(a, b, alpha, beta) -> tuple[float, ...]:
    up = [x + y - 1 for x, y in zip(a, alpha)]
    down = [x + y - 1 for x, y in zip(b, beta)]
    return tuple(u / (u + d) for u, d in zip(up, down))


@dataclass(frozen=True)
class BinomialParams(_Table):
    """Mixture weights and reference-allele probabilities; also used by the quality model."""

    priors_type: ClassVar = BinomialPriors
    pi: tuple[float, ...] = DEFAULT_PI
    mu_N: tuple[float, ...] = DEFAULT_MU
    mu_T: tuple[float, ...] = DEFAULT_MU

    def __post_init__(self):
        object.__setattr__(self, "pi", _simplex(self.pi))
        if not all(0 < mu < 1 for mu in (*self.mu_N, *self.mu_T)):
            raise ValueError("mu must lie strictly between 0 and 1")

    def updated(self, statistics: dict[str, tuple[float, ...]], priors: BinomialPriors) -> BinomialParams:
        """MAP estimate from expected statistics `n, a_N, b_N, a_T, b_T`."""
        return replace(
            self,
            pi=_updated_pi(statistics["n"], priors.pi),
            mu_N=_updated_mu(statistics["a_N"], statistics["b_N"], priors.mu_N_alpha, priors.mu_N_beta),
            mu_T=_updated_mu(statistics["a_T"], statistics["b_T"], priors.mu_T_alpha, priors.mu_T_beta),
        )

    def log_prior(self, priors: BinomialPriors) -> float:
        normal = zip(self.mu_N, priors.mu_N_alpha, priors.mu_N_beta)
        tumour = zip(self.mu_T, priors.mu_T_alpha, priors.mu_T_beta)
        return sum(beta_log_density(*x) for x in (*normal, *tumour)) + dirichlet_log_density(self.pi, priors.pi)


@dataclass(frozen=True)
class BetaBinomialParams(_Table):
    """Mixture weights and fixed Beta shapes."""

    priors_type: ClassVar = BetaBinomialPriors
    pi: tuple[float, ...] = DEFAULT_PI
    alpha_N: tuple[float, ...] = DEFAULT_ALPHA
    beta_N: tuple[float, ...] = DEFAULT_BETA
    alpha_T: tuple[float, ...] = DEFAULT_ALPHA
    beta_T: tuple[float, ...] = DEFAULT_BETA

    def __post_init__(self):
        object.__setattr__(self, "pi", _simplex(self.pi))
        if min(*self.alpha_N, *self.beta_N, *self.alpha_T, *self.beta_T) <= 0:
            raise ValueError("alpha and beta must be positive")

    def updated(self, statistics: dict[str, tuple[float, ...]], priors: BetaBinomialPriors) -> BetaBinomialParams:
        """MAP estimate of the weights; the shapes stay."""
        return replace(self, pi=_updated_pi(statistics["n"], priors.pi))

    def log_prior(self, priors: BetaBinomialPriors) -> float:
        return dirichlet_log_density(self.pi, priors.pi)
