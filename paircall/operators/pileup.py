"""From alignments to base observations, and aggregates over observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import normalise_bases
from ..functions.cigar import ONE_MATCH, reference_end
from ..functions.quality import decode_quality
from ..schema import BASE_CODES
from .segments import segments

_MATCH = ("M", "=", "X")
_STRETCH = 10  # a stretch has 2 ** _STRETCH positions


def _segments() -> Column:
    """`array<struct<ref,query,len,op,indel>>`, one entry per reference-consuming CIGAR operation.

    A read with one match operation, the common case, is made of plain expressions; only the others go to Python.
    """
    pos, cigar = F.col("pos"), F.col("cigar")
    plain = cigar.rlike(ONE_MATCH)
    single = [
        pos.alias("ref"),
        F.lit(0).alias("query"),
        F.regexp_extract(cigar, "^([0-9]+)", 1).try_cast("int").alias("len"),
        F.lit("M").alias("op"),
        F.lit(0).alias("indel"),
    ]
    return F.when(plain, F.array(F.struct(*single))).otherwise(segments(F.when(~plain, cigar), pos))


def side_by_side(reads: DataFrame) -> DataFrame:
    """The same reads, those that begin in one stretch of a contig side by side.

    Aggregates over the observations then combine most entries of a position in one task and shuffle little more than
    their results; of reads in any order they shuffle nearly every observation, and a read has many. A stretch is not
    bound to one task: Spark cuts stretches, or a single position, that are larger than its advisory partition size.
    """
    return reads.withColumn("_stretch", F.shiftright("pos", _STRETCH)).hint("rebalance", "chrom", "_stretch").drop("_stretch")


def expand(reads: DataFrame, annotate: bool = False, ref_skips: bool = True) -> DataFrame:
    """One row per read and covered reference position: `sample, chrom, pos, base, bq, mq`.

    Deletions and reference skips give rows with a null base; `ref_skips=False` leaves skips out.
    With `annotate` also `qname, read_start, is_del, is_refskip, indel, is_head, is_tail`.

    Sequence and quality travel as binary, where taking one position costs the same anywhere in the
    read; on strings it costs a walk from the start and long reads become quadratic. The explode
    refers to both columns, so they are read once per segment and not once per base.
    """
    needed = ["sample", "chrom", "pos", "mapq", "cigar", "seq", "qual"] + (["qname"] if annotate else [])
    reads = side_by_side(reads.select(*needed))
    carried = ["sample", "chrom", F.col("mapq").alias("mq")]
    if annotate:
        end = reference_end(F.col("pos"), F.col("cigar"))
        carried += ["qname", F.col("pos").alias("read_start"), (end - 1).alias("read_last")]
    pieces = reads.select(
        *carried,
        normalise_bases(F.col("seq")).cast("binary").alias("seq"),
        F.col("qual").cast("binary").alias("qual"),
        _segments().alias("_segments"),
    )
    pieces = pieces.select("*", F.inline("_segments")).drop("_segments").where("len > 0")
    if not ref_skips:
        pieces = pieces.where("op <> 'N'")

    match = F.col("op").isin(*_MATCH)
    cut = lambda column: F.when(match, F.substring(column, F.col("query") + 1, F.col("len")))
    pieces = pieces.withColumns({"seq": cut("seq"), "qual": cut("qual")})
    width = F.greatest("len", F.length("seq"), F.length("qual"))
    bases = pieces.withColumn("i", F.explode(F.sequence(F.lit(0), width - 1)))

    at = lambda column: F.substring(column, F.col("i") + 1, F.lit(1)).cast("string")
    position = F.col("ref") + F.col("i")
    columns = [
        "sample",
        "chrom",
        position.alias("pos"),
        F.when(match, F.coalesce(at("seq"), F.lit(""))).alias("base"),
        F.when(match, decode_quality(at("qual"))).alias("bq"),
        "mq",
    ]
    if annotate:
        columns += [
            "qname",
            "read_start",
            (~match).alias("is_del"),
            (F.col("op") == "N").alias("is_refskip"),
            F.when(F.col("i") == F.col("len") - 1, F.col("indel")).otherwise(0).alias("indel"),
            (position == F.col("read_start")).alias("is_head"),
            (position == F.col("read_last")).alias("is_tail"),
        ]
    return bases.select(*columns)


def passes(min_bq: int = 0, min_mq: int = 0) -> Column:
    """A base that counts: present, and at or above both quality thresholds."""
    return F.col("base").isNotNull() & (F.col("bq") >= min_bq) & (F.col("mq") >= min_mq)


def coverage(obs: DataFrame) -> DataFrame:
    """Entries and covered depth (entries with a base) per sample and position."""
    return obs.groupBy("sample", "chrom", "pos").agg(
        F.count("*").alias("entries"), F.count("base").alias("depth")
    )


def base_counts(obs: DataFrame, min_bq: int = 0, min_mq: int = 0) -> DataFrame:
    """Count per base letter that passes the thresholds, `n_A ... n_T, n_N`, per sample and position."""
    counted = passes(min_bq, min_mq)
    letters = ("A", "C", "G", "T", "N")
    return obs.groupBy("sample", "chrom", "pos").agg(
        *[F.count_if(counted & (F.col("base") == b)).alias(f"n_{b}") for b in letters]
    )


def base_histogram(obs: DataFrame, min_bq: int = 0, min_mq: int = 0) -> DataFrame:
    """Count of every base code, in long form `sample, chrom, pos, base, n`."""
    return obs.where(passes(min_bq, min_mq) & F.col("base").isin(*BASE_CODES)).groupBy(
        "sample", "chrom", "pos", "base"
    ).agg(F.count("*").alias("n"))


def multi_sample(obs: DataFrame, samples: list[str]) -> DataFrame:
    """Depth of every named sample at each position that any of them covers; `depth_<sample>`, 0 if absent."""
    depths = [F.count_if((F.col("sample") == s) & F.col("base").isNotNull()).alias(f"depth_{s}") for s in samples]
    return obs.where(F.col("sample").isin(*samples)).groupBy("chrom", "pos").agg(*depths)


def cap_depth(obs: DataFrame, cap: int, order: tuple[str, ...] = ("read_start", "qname"), salts: int = 64) -> DataFrame:
    """Keep the first `cap` entries, by `order`, of each sample and position.

    A position may hold far more than one task can sort: entries are ranked first within salted
    parts of a position, which leaves at most `cap` per part, and then over the position. The first
    `cap` overall are all among the first `cap` of their parts, so nothing is lost.
    """
    if not set(order) <= set(obs.columns):
        raise ValueError(f"cap_depth needs the columns {order}; expand reads with annotate=True")
    by = [F.col(c) for c in order]
    # The whole row decides on the part, so that entries with equal order columns spread as well.
    kinds = dict(obs.dtypes)
    part = F.pmod(F.xxhash64(*[F.col(c) for c in obs.columns if not kinds[c].startswith("map")]), F.lit(salts))
    within = Window.partitionBy("sample", "chrom", "pos", "_part").orderBy(*by)
    overall = Window.partitionBy("sample", "chrom", "pos").orderBy(*by)
    return (
        obs.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(within))
        .where(F.col("_rank") <= cap)
        .withColumn("_rank", F.row_number().over(overall))
        .where(F.col("_rank") <= cap)
        .drop("_part", "_rank")
    )
