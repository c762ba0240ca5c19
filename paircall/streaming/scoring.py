"""Stateless scoring of a stream of counted sites."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..models.density import Density
from ..models.scoring import score
from ..operators.labels import somatic_calls
from ..operators.sites import variant_sites


def score_stream(
    sites: DataFrame,
    params=None,
    model: str | Density = "binomial",
    all_positions: bool = False,
    somatic_threshold: float = 0.0,
) -> DataFrame:
    """Posteriors of the sites of a streaming DataFrame; row by row, so there is no state and no watermark."""
    if not sites.isStreaming:
        raise ValueError("score_stream takes a streaming DataFrame; use models.score for a batch")
    scored = score(sites if all_positions else variant_sites(sites), params, model)
    return somatic_calls(scored, somatic_threshold)
