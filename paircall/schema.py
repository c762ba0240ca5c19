"""Fixed values, column names and table schemas shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------------------------
GENOTYPES = ("AA", "AB", "BB")
JOINT_GENOTYPES = (
    "AA_AA", "AA_AB", "AA_BB",
    "AB_AA", "AB_AB", "AB_BB",
    "BB_AA", "BB_AB", "BB_BB",
)
LABELS = {
    "wildtype": ("AA_AA",),
    "somatic": ("AA_AB", "AA_BB"),
    "germline": ("AB_AB", "BB_BB"),
    "loh": ("AB_AA", "AB_BB"),
    "error": ("BB_AA", "BB_AB"),
}
NUCLEOTIDES = ("A", "C", "G", "T")
BASE_CODES = "=ACMGRSVTWYHKDBN"

FLAG_BITS = {
    "paired": 1,
    "proper_pair": 2,
    "unmapped": 4,
    "mate_unmapped": 8,
    "reverse": 16,
    "mate_reverse": 32,
    "read1": 64,
    "read2": 128,
    "secondary": 256,
    "qc_fail": 512,
    "duplicate": 1024,
}
FLAG_LETTERS = {
    "paired": "p",
    "proper_pair": "P",
    "unmapped": "u",
    "mate_unmapped": "U",
    "reverse": "r",
    "mate_reverse": "R",
    "read1": "1",
    "read2": "2",
    "secondary": "s",
    "qc_fail": "f",
    "duplicate": "d",
}
DEFAULT_MASK = 1796

RESULT_COLUMNS = (
    "chrom", "position", "ref_base", "var_base",
    "normal_counts_a", "normal_counts_b", "tumour_counts_a", "tumour_counts_b",
) + tuple(f"p_{g}" for g in JOINT_GENOTYPES)
# -----------------------------------------------------------------------------------------------

NORMAL, TUMOUR = "normal", "tumour"
SAMPLES = (NORMAL, TUMOUR)
SUFFIX = {NORMAL: "N", TUMOUR: "T"}
SITE = ("chrom", "pos")
COUNTS = ("a_N", "b_N", "a_T", "b_T")
POSTERIORS = tuple(f"p_{g}" for g in JOINT_GENOTYPES)

# Positions per reference chunk row unless a table says otherwise, and per bin in binned range joins (a power of two).
CHUNK = 128
BIN_SHIFT = 14

ALIGNMENT = T.StructType([
    T.StructField("sample", T.StringType()),
    T.StructField("qname", T.StringType()),
    T.StructField("flag", T.IntegerType()),
    T.StructField("chrom", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("mapq", T.IntegerType()),
    T.StructField("cigar", T.StringType()),
    T.StructField("mate_chrom", T.StringType()),
    T.StructField("mate_pos", T.IntegerType()),
    T.StructField("isize", T.IntegerType()),
    T.StructField("seq", T.StringType()),
    T.StructField("qual", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])

CHUNK_TABLE = T.StructType([
    T.StructField("chrom", T.StringType()),
    T.StructField("chunk_id", T.IntegerType()),
    T.StructField("chunk_start", T.IntegerType()),
    T.StructField("seq", T.StringType()),
    T.StructField("width", T.IntegerType()),
])

COUNT_TABLE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

PARAMETER_TABLE = T.StructType([
    T.StructField("component", T.StringType()),
    T.StructField("genotype", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
