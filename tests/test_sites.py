"""Pileup, counting and scoring against plain Python."""

from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from paircall.models import BetaBinomialParams, BinomialParams, score
from paircall.operators import pileup, positions, ranges, sites
from paircall.operators.reads import filter_flags
from paircall.operators.reference import fetch_intervals, fetch_region, with_reference_base
from paircall.plans import classify, observations, observe, paired_observations
from paircall.plans.classify import scored_sites
from paircall.schema import COUNTS, POSTERIORS

READS = brute.random_reads(600, 80)
REFERENCE = brute.random_reference(60)  # shorter than the alignments reach


@pytest.fixture(scope="module")
def reads(spark):
    return brute.reads_frame(spark, READS).cache()


@pytest.fixture(scope="module")
def chunks(spark):
    return brute.chunks_frame(spark, REFERENCE, 16).cache()


@pytest.fixture(scope="module")
def obs(reads):
    return observe(reads).cache()


def collect(df):
    return [tuple(r) for r in df.collect()]


def test_expand(obs):
    got = Counter(collect(obs.select("sample", "chrom", "pos", "base", "bq", "mq")))
    assert got == Counter(brute.pileup(READS))


def test_expand_long_read(spark):
    seq = "ACGT" * 5000
    read = dict(sample="normal", qname="long", flag=0, chrom="1", pos=5, mapq=9, cigar="9999M1I10000M", seq=seq, qual="I" * 20000)
    got = Counter(collect(observe(brute.reads_frame(spark, [read])).select("sample", "chrom", "pos", "base", "bq", "mq")))
    assert got == Counter(brute.pileup([read]))


def test_expand_without_skips(reads):
    kept = filter_flags(reads)
    gaps = lambda df: df.where("base IS NULL").count()
    with_skips, without = pileup.expand(kept), pileup.expand(kept, ref_skips=False)
    skipped = sum(n for r in READS if not r["flag"] & 1796 and r["chrom"] != "*" for n, op in brute.operations(r["cigar"]) if op == "N")
    assert gaps(with_skips) - gaps(without) == skipped > 0


def test_annotations(spark):
    def run(cigar, seq):
        read = dict(sample="normal", qname="r", flag=0, chrom="1", pos=10, mapq=5, cigar=cigar, seq=seq, qual="I" * len(seq))
        df = pileup.expand(brute.reads_frame(spark, [read]), annotate=True).orderBy("pos")
        return [(r.pos, r.indel, r.is_del, r.is_refskip, r.is_head, r.is_tail) for r in df.collect()]

    out = run("2M1I2M2D1M3N1M", "ACGTACG")
    assert [r[1] for r in out] == [0, 1, 0, -2, 0, 0, 0, 0, 0, 0, 0]
    assert [r[2] for r in out] == [False] * 4 + [True] * 2 + [False] + [True] * 3 + [False]
    assert [r[3] for r in out] == [False] * 7 + [True] * 3 + [False]
    assert [r[4] for r in out] == [True] + [False] * 10
    assert [r[5] for r in out] == [False] * 10 + [True]
    # After a pad operation the insertions up to the next aligned base add up.
    assert [r[1] for r in run("2M1P2I1P1I2M", "ACGTACG")] == [0, 3, 0, 0]


def test_missing_sequence(spark):
    read = dict(sample="normal", qname="r", flag=0, chrom="1", pos=0, mapq=5, cigar="3M", seq=None, qual=None)
    assert collect(observe(brute.reads_frame(spark, [read])).select("pos", "base", "bq")) == [(i, "", 0) for i in range(3)]


@pytest.mark.parametrize("min_bq,min_mq", [(0, 0), (10, 20), (41, 60)])
@pytest.mark.parametrize("width", [16, 128])
def test_joint_counts(spark, obs, min_bq, min_mq, width):
    chunks = brute.chunks_frame(spark, REFERENCE, width)
    got = {(r.chrom, r.pos): (r.ref_base, r.var_base, tuple(r[c] for c in COUNTS)) for r in sites.joint_counts(obs, chunks, min_bq, min_mq).collect()}
    want = {k: v[:3] for k, v in brute.joint(brute.pileup(READS), REFERENCE, min_bq, min_mq).items()}
    assert got == want


@pytest.mark.parametrize("min_bq,min_mq", [(0, 0), (10, 20)])
def test_joint_qualities(obs, chunks, min_bq, min_mq):
    want = brute.joint(brute.pileup(READS), REFERENCE, min_bq, min_mq)
    rows = sites.joint_qualities(obs, chunks, min_bq, min_mq).collect()
    assert len(rows) == len(want)
    for r in rows:
        ref, var, counts, reads = want[r.chrom, r.pos]
        assert (r.ref_base, r.var_base, tuple(r[c] for c in COUNTS)) == (ref, var, counts)
        for s, name in (("reads_N", "normal"), ("reads_T", "tumour")):
            got = Counter()
            for cell in r[s]:
                got[round(cell.q, 9), round(cell.r, 9)] += cell.n
            assert got == Counter((round(q, 9), round(p, 9)) for q, p in reads[name])


@pytest.mark.parametrize("model", ["binomial", "beta_binomial", "quality"])
def test_scored_sites(obs, chunks, model):
    params = (BetaBinomialParams if model == "beta_binomial" else BinomialParams)()
    want = brute.joint(brute.pileup(READS), REFERENCE, 3, 0)
    rows = scored_sites(obs, chunks, model, min_bq=3, all_positions=True).collect()
    assert len(rows) == len(want)
    for r in rows:
        _, _, counts, reads = want[r.chrom, r.pos]
        expected, _ = brute.posterior(model, vars(params), counts, reads)
        assert [r[p] for p in POSTERIORS] == pytest.approx(expected, abs=1e-9)
    variant = scored_sites(obs, chunks, model, min_bq=3)
    assert variant.count() == sum(1 for v in want.values() if v[2][3] > 0)


def test_quality_arrays_agree_with_sums(obs, chunks):
    by_arrays = score(sites.joint_qualities(obs, chunks), model="quality")
    by_sums = scored_sites(obs, chunks, "quality", all_positions=True)
    key = lambda df: {(r.chrom, r.pos): [r[p] for p in POSTERIORS] for r in df.collect()}
    a, b = key(by_arrays), key(by_sums)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_partitioning_and_order_do_not_matter(obs, chunks, monkeypatch):
    once = Counter(collect(sites.joint_counts(obs, chunks)))
    again = Counter(collect(sites.joint_counts(obs.orderBy(F.rand(5)).repartition(7), chunks)))
    assert once == again


def test_hot_position(spark):
    """A third of all observations at one position."""
    cold = spark.range(4000).select((F.col("id") % 500).alias("pos"), (F.col("id") % 2).alias("s"))
    hot = spark.range(2000).select(F.lit(77).alias("pos"), (F.col("id") % 2).alias("s"))
    frame = cold.unionByName(hot).select(
        F.when(F.col("s") == 0, "normal").otherwise("tumour").alias("sample"), F.lit("1").alias("chrom"),
        F.col("pos").cast("int").alias("pos"), F.lit("A").alias("ref_base"),
        F.when(F.col("s") == 0, "A").otherwise("C").alias("base"), F.lit(30).alias("bq"), F.lit(40).alias("mq"),
    )
    row = sites.joint_counts(frame).where("pos = 77").first()
    assert (row.a_N, row.b_N, row.a_T, row.b_T, row.var_base) == (1000, 0, 0, 1008, "C")
    cells = sites.joint_qualities(frame).where("pos = 77").first()
    assert len(cells.reads_N) <= 1 and len(cells.reads_T) <= 1


def test_unknown_contig_is_an_error(spark, chunks):
    at = spark.createDataFrame([("9", 1)], "chrom string, pos int")
    with pytest.raises(Exception, match="contig not in the reference: 9"):
        with_reference_base(at, chunks).collect()


@pytest.mark.parametrize("chunk", [16, 7])
def test_fetch_intervals(spark, chunk):
    chunks = brute.chunks_frame(spark, REFERENCE, chunk)
    wanted = [("1", 0, 5), ("1", 10, 37), ("2", 55, 900), ("2", 16, 16), ("1", 70, 80), ("2", 0, 60)]
    wanted += [("1", 0, 5), ("2", 3, None), ("1", -4, 3)]
    frame = spark.createDataFrame([(i, *w) for i, w in enumerate(wanted)] * 2, "id int, chrom string, start int, end int")
    got = Counter(tuple(r) for r in fetch_intervals(frame, chunks).collect())
    assert got == Counter([(i, c, s, e, REFERENCE[c][max(s, 0):e]) for i, (c, s, e) in enumerate(wanted)] * 2)
    with pytest.raises(Exception, match="contig not in the reference: 9"):
        fetch_intervals(spark.createDataFrame([("9", 0, 4)], "chrom string, start int, end int"), chunks).collect()


@pytest.mark.parametrize("share", [1, 3])
def test_many_intervals_over_one_locus(spark, share):
    """A chunk that many intervals want is dealt to several groups; the sequences are the same."""
    chunks = brute.chunks_frame(spark, REFERENCE, 7)
    name, text = next(iter(REFERENCE.items()))
    wanted = [(name, start, end) for start in range(6) for end in range(start, 25)] + [(name, 0, None), (name, 50, 900), (name, 900, 950)]
    frame = spark.createDataFrame(wanted * 2, "chrom string, start int, end int")
    got = Counter((r.start, r.end, r.sequence) for r in fetch_intervals(frame, chunks, share).collect())
    assert got == Counter((a, b, text[a:b]) for _, a, b in wanted * 2)


def test_reference_is_read_once(spark, tmp_path):
    """Where contigs end is read from the chunks' numbers: one scan has the sequence."""
    brute.chunks_frame(spark, REFERENCE, 16).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    name, text = next(iter(REFERENCE.items()))
    at = spark.createDataFrame([(name, p) for p in (0, 15, 16, 47, 59, 60, 63, 64, 500)], "chrom string, pos int")
    found = with_reference_base(at, chunks)
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("seq:string" in line for line in scans) == 1
    assert {r.pos: r.ref_base for r in found.collect()} == {p: text[min(p, len(text) - 1)].upper() for p in (0, 15, 16, 47, 59, 60, 63, 64, 500)}


def test_missing_chunk_is_an_error(spark):
    chunks = brute.chunks_frame(spark, REFERENCE, 16).where("chunk_id <> 1")
    at = spark.createDataFrame([(next(iter(REFERENCE)), 17)], "chrom string, pos int")
    with pytest.raises(Exception, match="no such chunk in the reference"):
        with_reference_base(at, chunks).collect()


def test_wrong_width_is_an_error(spark, chunks):
    at = spark.createDataFrame([("1", 40)], "chrom string, pos int")
    with pytest.raises(Exception, match="another width"):
        with_reference_base(at, chunks.withColumn("width", F.lit(10))).collect()


def test_fetch_region(spark, chunks):
    for text, want in (("1:11-37", ("1", 10, 37)), ("2:31", ("2", 30, None)), ("2", ("2", 0, None))):
        assert fetch_region(chunks, text).first().sequence == REFERENCE[want[0]][want[1]:want[2]]


def span(read):
    return read["pos"] + sum(n for n, op in brute.operations(read["cigar"]) if op in "MDN=X")


@pytest.mark.parametrize("rows", [200_000, 0])
def test_regions(spark, rows):
    wanted = [("1", 3, 9), ("1", 5, 30), ("1", 30, 31), ("1", 64, 70), ("2", 0, 1), ("2", 20, 80), ("2", 40, 50), ("2", 40, 45)]
    frame = brute.reads_frame(spark, READS)
    regions = spark.createDataFrame(wanted, "chrom string, start int, end int")
    overlap = lambda r, g: r["chrom"] == g[0] and r["pos"] < g[2] and span(r) > g[1]
    once = Counter(r.qname for r in ranges.in_regions(frame, regions, rows, shift=4).collect())
    assert once == Counter(r["qname"] for r in READS if any(overlap(r, g) for g in wanted))
    pairs = Counter((r.qname, r.region_start, r.region_end) for r in ranges.overlap_pairs(frame, regions, rows, shift=4).collect())
    assert pairs == Counter((r["qname"], g[1], g[2]) for r in READS for g in wanted if overlap(r, g))


@pytest.mark.parametrize("rows", [200_000, 0])
def test_positions(spark, obs, rows):
    listed = spark.createDataFrame([("1", 3), ("1", 3), ("2", 50), ("2", 9999)], "chrom string, pos int")
    got = Counter(collect(positions.at_positions(obs, listed, rows).select("sample", "chrom", "pos", "base", "bq", "mq")))
    assert got == Counter(e for e in brute.pileup(READS) if e[1:3] in {("1", 3), ("2", 50)})


def test_classify_at_positions(spark, reads, monkeypatch):
    reference = brute.random_reference(60)
    chunks = brute.chunks_frame(spark, reference)
    listed = spark.createDataFrame([(c, p) for c in "12" for p in range(0, 60, 3)], "chrom string, position int")
    halves = [reads.where(F.col("sample") == s) for s in ("normal", "tumour")]
    few = classify(paired_observations(*halves, positions=listed), chunks, "binomial", all_positions=True)
    every = classify(paired_observations(*halves), chunks, "binomial", all_positions=True)
    wanted = {(r.chrom, r.position - 1) for r in listed.collect()}
    rows = [r for r in every.collect() if (r.chrom, r.pos) in wanted]
    assert rows and few.collect() == rows
    late = classify(paired_observations(*halves), chunks, "binomial", all_positions=True, positions=listed)
    assert late.collect() == rows
    monkeypatch.setattr(observations, "is_small", lambda df: False)
    monkeypatch.setattr(observations, "at_positions", lambda df, keys: positions.at_positions(df, keys, 0))
    large = classify(paired_observations(*halves, positions=listed), chunks, "binomial", all_positions=True)
    assert large.collect() == rows


def test_classify_chromosome_must_be_shared(spark, reads):
    halves = [reads.where(F.col("sample") == s) for s in ("normal", "tumour")]
    dictionary = lambda *names: spark.createDataFrame([(n, 100) for n in names], "chrom string, length int")
    assert paired_observations(*halves, chromosome="1", contigs=(dictionary("1", "2"), dictionary("1"))).select("chrom").distinct().collect()[0][0] == "1"
    with pytest.raises(ValueError, match="unknown contig: 2"):
        paired_observations(*halves, chromosome="2", contigs=(dictionary("1", "2"), dictionary("1")))


def test_cap_depth(spark, reads):
    obs = pileup.expand(filter_flags(reads), annotate=True)
    got = Counter((r.sample, r.chrom, r.pos, r.qname) for r in pileup.cap_depth(obs, 3, salts=5).collect())
    by_position = {}
    for r in READS:
        if not r["flag"] & 1796 and r["chrom"] != "*":
            for pos, _, _ in brute.entries(r):
                by_position.setdefault((r["sample"], r["chrom"], pos), []).append((r["pos"], r["qname"]))
    want = Counter((*k, q) for k, v in by_position.items() for _, q in sorted(v)[:3])
    assert got == want
