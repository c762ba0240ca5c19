"""Scoring of site rows that arrive as a stream."""

from .scoring import score_stream

__all__ = ["score_stream"]
