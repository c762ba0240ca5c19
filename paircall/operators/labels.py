"""Labels derived from the nine posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logspace import total
from ..schema import JOINT_GENOTYPES, LABELS, POSTERIORS


def p_somatic() -> Column:
    return total([F.col(f"p_{g}") for g in LABELS["somatic"]])


def somatic_calls(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Sites whose probability of a somatic change is at least the threshold."""
    return scored.where(p_somatic() >= threshold)


def marginals(scored: DataFrame) -> DataFrame:
    """Add `p_wildtype, p_somatic, p_germline, p_loh, p_error`."""
    return scored.withColumns({
        f"p_{label}": total([F.col(f"p_{g}") for g in genotypes]) for label, genotypes in LABELS.items()
    })


def _best() -> Column:
    """Index of the most probable joint genotype, the first one on a tie."""
    highest = F.greatest(*POSTERIORS)
    return F.coalesce(*[F.when(F.col(p) == highest, i) for i, p in enumerate(POSTERIORS)])


def map_genotype(scored: DataFrame) -> DataFrame:
    """Add `genotype`, the most probable joint genotype, and its `label`."""
    label_of = {g: label for label, genotypes in LABELS.items() for g in genotypes}
    label = F.coalesce(*[F.when(F.col("genotype") == g, label_of[g]) for g in JOINT_GENOTYPES if g in label_of])
    names = F.array(*map(F.lit, JOINT_GENOTYPES))
    return scored.withColumn("genotype", F.get(names, _best())).withColumn("label", label)


def hard_assign(scored: DataFrame) -> DataFrame:
    """Posteriors replaced by 1 for the most probable joint genotype and 0 for the others."""
    best = scored.withColumn("_best", _best())
    return best.withColumns({
        p: F.when(F.col("_best") == i, 1.0).otherwise(0.0) for i, p in enumerate(POSTERIORS)
    }).drop("_best")


def to_long(scored: DataFrame) -> DataFrame:
    """Nine rows per site: `joint_genotype, normal_genotype, tumour_genotype, probability`."""
    kept = [c for c in scored.columns if c not in POSTERIORS]
    entries = F.array(*[
        F.struct(
            F.lit(g).alias("joint_genotype"),
            F.lit(g[:2]).alias("normal_genotype"),
            F.lit(g[3:]).alias("tumour_genotype"),
            F.col(f"p_{g}").alias("probability"),
        )
        for g in JOINT_GENOTYPES
    ])
    return scored.select(*kept, F.inline(entries))
