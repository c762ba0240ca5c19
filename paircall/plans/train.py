"""Training of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..models.density import DEFAULT_MODEL, Density, model_by_name
from ..models.em import FitResult, fit
from ..operators.durable import durable
from ..operators.sampling import every_kth, every_kth_site
from ..operators.sites import in_depth_range, joint_counts, joint_qualities, quality_cells
from .observations import listed


def eligible_sites(
    obs: DataFrame,
    reference: DataFrame | None = None,
    model: str | Density = DEFAULT_MODEL,
    min_bq: int = 0,
    min_mq: int = 0,
    min_normal_depth: int = 10,
    max_normal_depth: int = 100,
    min_tumour_depth: int = 10,
    max_tumour_depth: int = 100,
    positions: DataFrame | None = None,
) -> DataFrame:
    """Sites within the depth ranges; read qualities only where the model needs them."""
    count = joint_qualities if model_by_name(model).needs_reads else joint_counts
    sites = listed(count(obs, reference, min_bq, min_mq), positions)
    return in_depth_range(sites, min_normal_depth, max_normal_depth, min_tumour_depth, max_tumour_depth)


def eligible_cells(
    obs: DataFrame, reference: DataFrame | None = None, min_bq: int = 0, min_mq: int = 0, positions: DataFrame | None = None, **limits
) -> DataFrame:
    """The reads of the sites within the depth ranges, as `quality_cells`; `limits` are those of `in_depth_range`."""
    named = {name.removesuffix("_depth"): value for name, value in limits.items()}
    return in_depth_range(listed(quality_cells(obs, reference, min_bq, min_mq), positions), **named)


def training_rows(
    obs: DataFrame, reference: DataFrame | None = None, model: str | Density = DEFAULT_MODEL, skip: int = 1, **limits
) -> DataFrame:
    """What EM iterates over, of every `skip`-th eligible site; reads stay in rows where the model takes them so."""
    density = model_by_name(model)
    if density.takes_cells:
        return density.from_cells(every_kth_site(eligible_cells(obs, reference, **limits), skip))
    return density.compress(training_sites(obs, reference, density, skip, **limits))


def training_sites(
    obs: DataFrame, reference: DataFrame | None = None, model: str | Density = DEFAULT_MODEL, skip: int = 1, **limits
) -> DataFrame:
    """Every `skip`-th eligible site in genome order."""
    return every_kth(eligible_sites(obs, reference, model, **limits), skip)


def train(
    obs: DataFrame,
    reference: DataFrame | None = None,
    model: str | Density = DEFAULT_MODEL,
    priors=None,
    params=None,
    skip: int = 1,
    max_iters: int = 1000,
    tolerance: float = 1e-6,
    **limits,
) -> FitResult:
    """Select training sites and fit the model.

    Sampling reads the eligible sites twice (places and offsets), so they are kept while it runs.
    """
    density = model_by_name(model)
    if density.takes_cells:
        eligible, sample, rows = eligible_cells(obs, reference, **limits), every_kth_site, density.from_cells
    else:
        eligible, sample, rows = eligible_sites(obs, reference, density, **limits), every_kth, density.compress
    if skip <= 1:
        return fit(rows(eligible), density, priors, params, max_iters, tolerance, compressed=True)
    eligible = durable(eligible)
    try:
        return fit(rows(sample(eligible, skip)), density, priors, params, max_iters, tolerance, compressed=True)
    finally:
        eligible.unpersist()
