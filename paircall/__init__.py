"""Paired-sample allele analysis on Spark DataFrames."""
