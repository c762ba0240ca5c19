"""Observations of two BAM files, reading only what the request needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import position_keys
from ..operators.reads import require_contig, shared_contigs
from ..schema import DEFAULT_MASK
from ..sources.bam import LINEAR_SHIFT, SPLIT_BYTES, read_bam, read_bam_contigs
from .observations import paired_observations

# Windows of the index that are asked for one by one; a denser list reads whole contigs.
WINDOWS = 20_000

Regions = list[tuple[str, int, int | None]]


def listed_regions(positions: DataFrame, windows: int = WINDOWS) -> Regions:
    """Regions that hold all listed positions, in whole windows of the index; whole contigs if there are too many."""
    keys = position_keys(positions)
    touched = keys.select("chrom", F.shiftright("pos", LINEAR_SHIFT).alias("window")).distinct()
    found = sorted(tuple(r) for r in touched.limit(windows + 1).collect())
    if len(found) > windows:
        return [(r.chrom, 0, None) for r in keys.select("chrom").distinct().collect()]
    regions: list[tuple[str, int, int]] = []
    for chrom, window in found:
        start, end = window << LINEAR_SHIFT, (window + 1) << LINEAR_SHIFT
        if regions and regions[-1][0] == chrom and regions[-1][2] == start:
            start = regions.pop()[1]
        regions.append((chrom, start, end))
    return regions


def bam_observations(
    spark: SparkSession,
    normal: str,
    tumour: str,
    mask: int = DEFAULT_MASK,
    chromosome: str | None = None,
    positions: DataFrame | None = None,
    ref_skips: bool = True,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """`paired_observations` of two BAM paths, through their indexes.

    Only the parts of the files are read that may hold the chromosome or the listed positions. A chromosome that one
    of the dictionaries lacks is an error; listed positions on unknown contigs match nothing.
    """
    contigs = (read_bam_contigs(spark, normal), read_bam_contigs(spark, tumour))
    regions: Regions | None = None
    if chromosome is not None:
        require_contig(shared_contigs(*contigs), chromosome)
        regions = [(chromosome, 0, None)]
    if positions is not None:
        shared = {r.chrom for r in shared_contigs(*contigs).collect()}
        regions = [r for r in listed_regions(positions) if r[0] in shared and chromosome in (None, r[0])]
    reads = [
        read_bam(spark, path, sample, tags=False, split_bytes=split_bytes, regions=regions, whole=True)
        for path, sample in ((normal, "normal"), (tumour, "tumour"))
    ]
    return paired_observations(*reads, mask=mask, chromosome=chromosome, positions=positions, ref_skips=ref_skips)
