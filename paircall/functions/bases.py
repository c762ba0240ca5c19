"""Sequence letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BASE_CODES

_ASCII = [chr(c) for c in range(33, 127)]
_COLOUR_SPACE = dict(zip("0123", "ACGT"))


def _normal_form(char: str) -> str:
    char = _COLOUR_SPACE.get(char, char.upper())
    return char if char in BASE_CODES else "N"


_FROM = "".join(c for c in _ASCII if _normal_form(c) != c)
_TO = "".join(_normal_form(c) for c in _FROM)


def normalise_bases(seq: Column) -> Column:
    """Upper-case IUPAC letters; digits 0-3 are A, C, G, T and any other character, of whatever script, is N."""
    return F.regexp_replace(F.translate(seq, _FROM, _TO), f"[^{BASE_CODES}]", "N")
