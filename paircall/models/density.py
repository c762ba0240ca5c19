"""Densities. A new model is a subclass that says how a site's log-likelihood per genotype is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.likelihood import (
    beta_binomial_loglik,
    binomial_loglik,
    read_likelihood,
    reads_loglik,
)
from ..functions.logspace import total
from ..schema import COUNTS, GENOTYPES, SITE
from .params import BetaBinomialParams, BinomialParams

SAMPLE_SUFFIXES = ("N", "T")


def loglik_name(sample: str, genotype: str) -> str:
    return f"l_{sample}_{genotype}"


LOGLIKS = tuple(loglik_name(s, g) for s in SAMPLE_SUFFIXES for g in GENOTYPES)


class Density:
    """Log-likelihood of a site under each genotype of each sample.

    `with_loglik` adds the six columns `l_<sample>_<genotype>`; `allele_terms` gives what a site adds to the
    expected reference and variant alleles of a genotype, or None where the model has no such parameters.
    Both return plain column expressions, so a density works in batch, in streams and inside EM.
    """

    name: str
    params_type: type
    needs_reads = False
    takes_cells = False  # whether `from_cells` makes training rows of the long form of reads
    training_keys: tuple[str, ...] = ()  # columns that `terms` groups the training table by

    def with_loglik(self, sites: DataFrame, params) -> DataFrame:
        raise NotImplementedError

    def allele_terms(self, sample: str, genotype: str) -> tuple[Column, Column] | None:
        return None

    def compress(self, sites: DataFrame) -> DataFrame:
        """Training rows with a weight `w`; equal count tuples are one row, whatever the genome's length."""
        return sites.groupBy(*COUNTS).agg(F.count("*").alias("w"))

    def from_cells(self, cells: DataFrame) -> DataFrame:
        """Training rows of `operators.sites.quality_cells`, without a gather of reads per site."""
        raise NotImplementedError

    def terms(self, training: DataFrame, params) -> DataFrame:
        """One row per weighted training site with log-likelihoods and allele terms as columns."""
        return self.with_loglik(training, params)


class Binomial(Density):
    name = "binomial"
    params_type = BinomialParams

    def with_loglik(self, sites: DataFrame, params: BinomialParams) -> DataFrame:
        return sites.withColumns({
            loglik_name(s, g): binomial_loglik(F.col(f"a_{s}"), F.col(f"b_{s}"), mu)
            for s in SAMPLE_SUFFIXES
            for g, mu in zip(GENOTYPES, getattr(params, f"mu_{s}"))
        })

    def allele_terms(self, sample: str, genotype: str) -> tuple[Column, Column]:
        return F.col(f"a_{sample}"), F.col(f"b_{sample}")


class BetaBinomial(Density):
    name = "beta_binomial"
    params_type = BetaBinomialParams

    def with_loglik(self, sites: DataFrame, params: BetaBinomialParams) -> DataFrame:
        return sites.withColumns({
            loglik_name(s, g): beta_binomial_loglik(F.col(f"a_{s}"), F.col(f"b_{s}"), alpha, beta)
            for s in SAMPLE_SUFFIXES
            for g, alpha, beta in zip(GENOTYPES, getattr(params, f"alpha_{s}"), getattr(params, f"beta_{s}"))
        })


class Quality(Density):
    """Uses base and mapping qualities of every read; sites carry `reads_N` and `reads_T`."""

    name = "quality"
    params_type = BinomialParams
    needs_reads = True
    takes_cells = True
    training_keys = SITE

    def with_loglik(self, sites: DataFrame, params: BinomialParams) -> DataFrame:
        return sites.withColumns({
            loglik_name(s, g): reads_loglik(F.col(f"reads_{s}"), mu)
            for s in SAMPLE_SUFFIXES
            for g, mu in zip(GENOTYPES, getattr(params, f"mu_{s}"))
        })

    def compress(self, sites: DataFrame) -> DataFrame:
        """Long form, one row per site, sample and distinct (q, r); a site without reads keeps one empty row."""
        def marked(s: str) -> Column:
            return F.transform(f"reads_{s}", lambda x: F.struct(F.lit(s).alias("s"), *[x[c].alias(c) for c in "qrn"]))

        cells = F.concat(*[marked(s) for s in SAMPLE_SUFFIXES])
        return sites.select(*SITE, F.explode_outer(cells).alias("c")).select(*SITE, "c.*")

    def from_cells(self, cells: DataFrame) -> DataFrame:
        return cells.select(*SITE, "s", "q", "r", "n")

    def terms(self, training: DataFrame, params: BinomialParams) -> DataFrame:
        """Per-site sums over the long form.

        The training table is kept partitioned by site, so this grouping needs no shuffle, and its arithmetic is
        generated code where a fold over arrays would be interpreted.
        """
        q, r, n = F.col("q"), F.col("r"), F.col("n")
        rows, sums = training, []
        for s in SAMPLE_SUFFIXES:
            for g, mu in zip(GENOTYPES, getattr(params, f"mu_{s}")):
                mine = F.col("s") == s
                likelihood = read_likelihood(q, r, mu)
                reference = F.lit(mu) * (F.lit(0.5) + r * (q - F.lit(0.5))) / likelihood
                sums.append(F.sum(F.when(mine, n * F.ln(likelihood)).otherwise(0.0)).alias(loglik_name(s, g)))
                sums.append(F.sum(F.when(mine, n * reference).otherwise(0.0)).alias(f"a_{s}_{g}"))
            sums.append(F.sum(F.when(F.col("s") == s, n).otherwise(0)).alias(f"d_{s}"))
        return rows.groupBy(*SITE).agg(*sums).withColumn("w", F.lit(1))

    def allele_terms(self, sample: str, genotype: str) -> tuple[Column, Column]:
        # Expected reference and variant alleles of a read add up to one.
        reference = F.col(f"a_{sample}_{genotype}")
        return reference, F.col(f"d_{sample}") - reference


MODELS: dict[str, Density] = {m.name: m for m in (Binomial(), BetaBinomial(), Quality())}
DEFAULT_MODEL = "quality"


def model_by_name(model: str | Density) -> Density:
    if isinstance(model, Density):
        return model
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; one of {', '.join(MODELS)}")
    return MODELS[model]


def marginal(resp: list[Column], sample: str, index: int) -> Column:
    """Posterior of one sample's genotype: the joint posteriors summed over the other sample."""
    chosen = resp[3 * index:3 * index + 3] if sample == "N" else resp[index::3]
    return total(chosen)
