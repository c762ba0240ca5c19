"""From reads of two samples to one table of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pileup import expand
from ..operators.positions import at_positions, position_keys, reads_near
from ..operators.reads import filter_flags, on_chromosome, require_contig, shared_contigs
from ..operators.sizing import is_small
from ..schema import DEFAULT_MASK, SAMPLES

_NEEDED = ("sample", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual")


def observe(reads: DataFrame, mask: int = DEFAULT_MASK, chromosome: str | None = None, ref_skips: bool = True) -> DataFrame:
    """Base observations of the reads that pass the flag filter."""
    kept = on_chromosome(filter_flags(reads.select(*_NEEDED), mask), chromosome)
    return expand(kept, ref_skips=ref_skips)


def paired_observations(
    normal: DataFrame,
    tumour: DataFrame,
    mask: int = DEFAULT_MASK,
    chromosome: str | None = None,
    positions: DataFrame | None = None,
    contigs: tuple[DataFrame, DataFrame] | None = None,
    ref_skips: bool = True,
) -> DataFrame:
    """Observations of both samples.

    With contig dictionaries a requested chromosome must be in both. With a small positions list, reads
    that cover none of it are dropped before they are expanded, and other positions right after, both
    map-side. A list too large to broadcast is better given to `classify` or `train`, which apply it to the
    aggregated sites; here it costs a shuffle of the observations.
    """
    if contigs is not None and chromosome is not None:
        require_contig(shared_contigs(*contigs), chromosome)
    reads = normal.select(*_NEEDED).unionByName(tumour.select(*_NEEDED))
    reads = on_chromosome(filter_flags(reads, mask), chromosome).where(F.col("sample").isin(*SAMPLES))
    if positions is None:
        return expand(reads, ref_skips=ref_skips)
    keys = position_keys(positions)
    near = reads_near(reads, keys) if is_small(keys) else reads
    return at_positions(expand(near, ref_skips=ref_skips), keys)


def listed(sites: DataFrame, positions: DataFrame | None) -> DataFrame:
    """Sites at the listed positions. Sites are partitioned by position already, so only the list is shuffled."""
    return sites if positions is None else at_positions(sites, positions)
