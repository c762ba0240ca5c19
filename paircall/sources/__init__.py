"""Readers. Each returns a lazy DataFrame."""

from .bam import read_bam, register_bam
from .fasta import read_fai, read_fasta
from .sam import read_contigs, read_read_groups, read_sam
from .tables import read_counts, read_params, read_positions, read_priors

__all__ = [
    "read_bam", "register_bam", "read_fai", "read_fasta", "read_contigs", "read_read_groups", "read_sam",
    "read_counts", "read_params", "read_positions", "read_priors",
]
