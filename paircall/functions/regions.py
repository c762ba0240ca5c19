"""Region strings, overlap tests and genomic bins."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\n\x0b\f\r"
_INTERVAL = "^[0-9,]*(?:-[0-9,]*)?\\z"
_LINE_ENDS = "\u0085\u2028\u2029"  # line ends besides these blanks; a region holds none but for one at its end


def _number(text: Column) -> Column:
    """Leading digits without thousands separators; 0 when there are none."""
    return F.coalesce(F.replace(text, F.lit(",")).try_cast("long"), F.lit(0).cast("long"))


def region_parts(text: Column) -> Column:
    """`(whole, chrom, start, end)` of a region string, unchecked; `whole` is the string without white space.

    The interval is what follows the last colon: digits and commas, and at most one dash. It is found by searches for single
    characters, and one pattern tells what it is; a pattern for each part costs more.
    """
    compact = reduce(lambda found, blank: F.replace(found, F.lit(blank), F.lit("")), _BLANKS, text)
    ends = reduce(or_, [compact.endswith(c) for c in _LINE_ENDS])
    line = F.when(ends, F.left(compact, F.length(compact) - 1)).otherwise(compact)
    interval = F.substring_index(line, ":", -1)
    one_line = ~reduce(or_, [line.contains(c) for c in _LINE_ENDS])
    has_interval = line.contains(":") & interval.rlike(_INTERVAL) & one_line
    begin = _number(F.substring_index(interval, "-", 1))
    return F.struct(
        compact.alias("whole"),
        F.when(has_interval, F.left(line, F.length(line) - F.length(interval) - 1)).otherwise(compact).alias("chrom"),
        F.when(has_interval, F.greatest(begin - 1, F.lit(0))).otherwise(0).cast("long").alias("start"),
        F.when(has_interval & interval.contains("-"), _number(F.substring_index(interval, "-", -1))).cast("long").alias("end"),
    )


def checked_end(start: Column, end: Column, text: Column) -> Column:
    """The end; an error where it lies before the start, as in `chr:500-100`, and in `chr:100-`, whose end is 0."""
    return F.when(start > end, F.raise_error(F.concat(F.lit("malformed region: "), text)).cast("long")).otherwise(end)


def parse_region(text: Column) -> Column:
    """`chr:beg-end` (1-based, commas allowed) to a half-open 0-based struct `(chrom, start, end)`.

    A region without an end, `chr:beg`, reaches to the end of the contig: its `end` is null. Text that is no interval is part of
    the name. An interval that ends before it starts is an error. Where contigs have colons in their names, use
    `operators.ranges.resolve_regions`, which knows the names.
    """
    parts = region_parts(text)
    start = parts["start"]
    return F.struct(parts["chrom"].alias("chrom"), start.alias("start"), checked_end(start, parts["end"], text).alias("end"))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start < other_end) & (end > other_start)


def genomic_bin(start: Column, end: Column) -> Column:
    """Number of the smallest bin of the five-level binning scheme that holds [start, end)."""
    last = end - 1
    result = F.when(F.shiftright(start, 14) == F.shiftright(last, 14), F.shiftright(start, 14) + ((1 << 15) - 1) // 7)
    for shift, level in ((17, 12), (20, 9), (23, 6), (26, 3)):
        offset = ((1 << level) - 1) // 7
        result = result.when(F.shiftright(start, shift) == F.shiftright(last, shift), F.shiftright(start, shift) + offset)
    return result.otherwise(0)
