"""Classification of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..models.density import DEFAULT_MODEL, Density, Quality, model_by_name
from ..models.scoring import posteriors, score
from ..operators.labels import somatic_calls
from ..operators.sites import joint_counts, joint_qualities, joint_quality_loglik, variant_sites
from ..sinks.tables import in_order
from .observations import listed


def scored_sites(
    obs: DataFrame,
    reference: DataFrame | None = None,
    model: str | Density = DEFAULT_MODEL,
    params=None,
    min_bq: int = 0,
    min_mq: int = 0,
    all_positions: bool = False,
    positions: DataFrame | None = None,
) -> DataFrame:
    """Count sites and add the nine posteriors; by default only sites with a variant read in the tumour.

    The quality model sums its log-likelihoods while counting and collects no reads. A custom density that
    needs reads gets them as arrays.
    """
    density = model_by_name(model)
    params = density.params_type() if params is None else params
    if isinstance(density, Quality):
        sites = joint_quality_loglik(obs, params.mu_N, params.mu_T, reference, min_bq, min_mq)
    else:
        count = joint_qualities if density.needs_reads else joint_counts
        sites = count(obs, reference, min_bq, min_mq)
    sites = listed(sites if all_positions else variant_sites(sites), positions)
    return posteriors(sites, params.pi) if isinstance(density, Quality) else score(sites, params, density)


def classify(
    obs: DataFrame,
    reference: DataFrame | None = None,
    model: str | Density = DEFAULT_MODEL,
    params=None,
    min_bq: int = 0,
    min_mq: int = 0,
    all_positions: bool = False,
    somatic_threshold: float = 0.0,
    positions: DataFrame | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Scored sites with at least the given probability of a somatic change, in genome order."""
    scored = scored_sites(obs, reference, model, params, min_bq, min_mq, all_positions, positions)
    calls = somatic_calls(scored, somatic_threshold) if somatic_threshold > 0 else scored
    return in_order(calls) if ordered else calls
