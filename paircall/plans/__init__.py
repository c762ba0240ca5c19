"""Whole analyses composed from the operators."""

from .alignments import bam_observations
from .classify import classify
from .observations import observe, paired_observations
from .train import train, training_rows, training_sites

__all__ = ["bam_observations", "classify", "observe", "paired_observations", "train", "training_rows", "training_sites"]
