"""What keeps large inputs cheap: entries of a position combine before they are shuffled, region strings take one pattern."""

import re

from pyspark.sql import functions as F

from paircall.functions.regions import parse_region, region_parts
from paircall.operators import pileup


def test_a_position_is_in_few_tasks(spark):
    pos = (F.col("id") * 7919 % 4000).cast("int")
    seq = F.lit("ACGTACGTAC")
    reads = spark.range(0, 40_000, 1, 4).select(
        F.lit("normal").alias("sample"), F.lit("1").alias("chrom"), pos.alias("pos"), F.lit(30).alias("mapq"), F.lit("10M").alias("cigar"), seq.alias("seq"), seq.alias("qual")
    )
    obs = pileup.expand(reads)
    places = obs.select("chrom", "pos", F.spark_partition_id()).distinct().count()
    positions = obs.select("pos").distinct().count()
    assert obs.count() == 400_000 and places < 1.1 * positions


def test_null_positions_stay(spark):
    reads = spark.createDataFrame([("normal", None, 3, 9, "2M", "AC", "II"), ("normal", "1", 5, 9, "1M1D1M", "AC", "II")] * 2, "sample string, chrom string, pos int, mapq int, cigar string, seq string, qual string")
    found = sorted((r.chrom or "", r.pos, r.base or "") for r in pileup.expand(reads).collect())
    assert found == sorted([("", 3, "A"), ("", 4, "C"), ("1", 5, "A"), ("1", 6, ""), ("1", 7, "C")] * 2)


PATTERN = re.compile("^([^\u0085  ]*):([0-9,]*)(?:(-)([0-9,]*))?[\u0085  ]?\\Z")


def plain(text):
    if text is None:
        return None, None, 0, None
    compact = re.sub("[ \t\n\x0b\f\r]+", "", text)
    found = PATTERN.match(compact)
    number = lambda x: int(x.replace(",", "") or 0) if int(x.replace(",", "") or 0) < 2**63 else 0
    if not found:
        return compact, compact, 0, None
    return compact, found[1], max(number(found[2]) - 1, 0), number(found[4]) if found[3] else None


def test_region_parts(spark):
    tails = ["", "5", "1,000", "5-9", "1,0-2,000", "-", "-7", "5-", "5-6-7", "x", "5 ", "5  ", "\u00855", " 1 - 9 ", "99999999999999999999", "1:2-3", "٣"]
    texts = [None, "", ":", "chr", "5-9", "a b", *[f"{name}:{tail}" for name in ("", "chr", "HLA:A*01", "é ", "a\u0085b") for tail in tails]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", region_parts(F.col("t")).alias("r")).collect()
    assert {r.t: tuple(r.r) for r in rows} == {t: plain(t) for t in texts}


def test_one_pattern_a_part(spark):
    parsed = spark.range(1).select(parse_region(F.col("id").cast("string")).alias("r"))
    plan = parsed.select("r.chrom")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp") + plan.count("rlike") <= 1
