"""Alignment flags: parsing, masks and the letter form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FLAG_BITS, FLAG_LETTERS


def has_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def parse_flag(text: Column) -> Column:
    """Decimal, 0x hexadecimal, 0-prefixed octal, or a string of flag letters."""
    letters = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.instr(text, letter) > 0, FLAG_BITS[name]).otherwise(0) for name, letter in FLAG_LETTERS.items()],
    )
    return (
        F.when((text == "0") | ((text >= "1") & (text < ":") & text.try_cast("int").isNotNull()), text.try_cast("int"))
        .when(text.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(text, 3, 16), 16, 10).try_cast("int"))
        .when(text.rlike("^0[0-7]+$"), F.conv(text, 8, 10).try_cast("int"))
        .otherwise(letters)
    )


def flag_letters(flag: Column) -> Column:
    """The letters of all set bits, lowest bit first."""
    return F.concat(*[
        F.when(has_bits(flag, FLAG_BITS[name]), letter).otherwise("") for name, letter in FLAG_LETTERS.items()
    ])
