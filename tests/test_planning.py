"""Index planning over many regions, folders of BAM files, dense range joins, and plans that are built without a job."""

import time
from collections import Counter

import bam_files
import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from paircall.functions.regions import parse_region
from paircall.operators import positions, ranges, sizing
from paircall.plans import bam_observations, paired_observations
from paircall.sources import bam, read_bam
from paircall.sources.bam import read_bam_contigs, read_bam_index_stats


def plain_ranges(entry, regions):
    """The definition, region by region: all windows and leaves are looked at."""
    found = []
    for start, until in regions:
        begin, end = entry.begin, entry.end
        if start > 0 and entry.linear:
            begin = max(begin, next((v for v in entry.linear[start >> bam.LINEAR_SHIFT :] if v), end))
        if until is not None:
            window = -(-max(until, 0) >> bam.LINEAR_SHIFT)
            end = min([end, *(v for w, v in entry.leaves.items() if w >= window)])
        found.append((begin, end))
    return found


def index_entry(draw, windows):
    at = np.sort(draw.integers(1 << 20, 1 << 40, windows))
    linear = np.where(draw.random(windows) < 0.2, 0, at).tolist()
    leaves = {int(w): int(at[w]) + 5 for w in draw.choice(windows, windows // 2, replace=False)}
    return bam.ContigIndex(int(at[0]), int(at[-1]) + (1 << 20), linear, leaves)


def test_ranges_by_search():
    draw = np.random.default_rng(1)
    for windows in (1, 2, 40):
        entry = index_entry(draw, windows)
        regions = [(int(s), None if draw.random() < 0.2 else int(s + draw.integers(0, 90_000))) for s in draw.integers(-5, (windows + 3) << 14, 300)]
        begin, end = entry.ranges(*np.array([(s, bam.NO_END if u is None else u) for s, u in regions]).T)
        assert list(zip(begin.tolist(), end.tolist())) == plain_ranges(entry, regions)
        header = bam.Header("", ["1", "2"], [1 << 30] * 2)
        empty = bam.ContigIndex(None, None, [], {})
        merged = bam.wanted_ranges(header, [entry, empty], [("1", *r) for r in regions] + [("2", 0, None), ("9", 0, None)])
        covered = lambda parts: sorted({x for a, b in parts for x in (a, b - 1) if a < b})
        inside = lambda x: any(a <= x < b for a, b in merged)
        assert all(map(inside, covered(plain_ranges(entry, regions)))) and all(b < c for (_, b), (c, _) in zip(merged, merged[1:]))
    assert bam.wanted_ranges(header, [entry, empty], []) == [] and bam.wanted_ranges(header, [entry, empty], [("*", 0, None)]) is None


def test_twenty_thousand_regions_are_planned_at_once(monkeypatch):
    """20 000 regions on a contig of 15 000 windows, with 2 000 cuts."""
    draw = np.random.default_rng(2)
    entry = index_entry(draw, 15_000)
    offsets = sorted(v for v in entry.linear if v)[::7]
    monkeypatch.setattr(bam, "read_index", lambda path: ([entry], offsets))
    monkeypatch.setattr(bam, "index_path", lambda path: path)
    regions = [("1", int(s), int(s) + 500) for s in np.sort(draw.integers(0, 15_000 << 14, 20_000))]
    begin = time.perf_counter()
    splits = bam.plan_splits("x", entry.end >> 16, 1 << 20, regions, bam.Header("", ["1"], [1 << 30]), entry.begin)
    assert time.perf_counter() - begin < 0.5
    ranges_ = bam.wanted_ranges(bam.Header("", ["1"], [1 << 30]), [entry], regions)
    assert all(splits[i].begin < 0 or any(a <= splits[i].begin < b for a, b in ranges_) for i in range(0, len(splits), 997))
    assert sum((s.limit or 0) > 0 for s in splits) == len(splits) > len(ranges_) // 2


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """Two folders of two files each, one with a contig that the other does not have."""
    paths, reads = {}, {}
    for sample in ("normal", "tumour"):
        folder = tmp_path_factory.mktemp(sample)
        paths[sample], reads[sample] = str(folder), []
        for name, contigs in (("a", ("1", "2")), ("b", ("2", "3"))):
            rows = brute.random_reads(300, 50_000, contigs=contigs)
            for r in rows:
                r["sample"] = sample
                if r["chrom"] == "*":
                    r["pos"], r["flag"] = -1, 4
            (folder / name).mkdir()
            bam_files.write(str(folder / name / "x.bam"), rows, list(contigs), [100_000] * 2, brute.operations)
            reads[sample] += rows
    return paths, reads


def test_two_folders(spark, folders):
    paths, reads = folders
    contigs = {r.chrom: (r.length, r.tid) for r in read_bam_contigs(spark, paths["normal"]).collect()}
    assert contigs == {"1": (100_000, 0), "2": (100_000, 0), "3": (100_000, 1)}
    mapped = {r.chrom: r.mapped + r.unmapped for r in read_bam_index_stats(spark, paths["normal"]).collect()}
    assert mapped == {c: sum(r["chrom"] == c for r in reads["normal"]) for c in "123"}
    assert read_bam(spark, paths["normal"], "normal").count() == len(reads["normal"])
    listed = spark.createDataFrame([(c, p) for c in "1239" for p in range(0, 6000, 2)], "chrom string, pos int")
    halves = [read_bam(spark, paths[s], s) for s in paths]
    for options in ({}, {"chromosome": "3"}, {"positions": listed}):
        got = Counter(map(tuple, bam_observations(spark, paths["normal"], paths["tumour"], split_bytes=600, **options).collect()))
        assert got == Counter(map(tuple, paired_observations(*halves, **options).collect())) and got
    with pytest.raises(ValueError, match="unknown contig: 7"):
        read_bam(spark, paths["normal"], "normal", regions=[("7", 0, 10)])


def test_contigs_that_differ_between_files(spark, tmp_path):
    for name, length in (("a", 1000), ("b", 2000)):
        bam_files.write(str(tmp_path / f"{name}.bam"), brute.random_reads(5, 500, contigs=("1",)), ["1"], [length], brute.operations)
    with pytest.raises(ValueError, match="contig 1 has lengths"):
        read_bam(spark, str(tmp_path), "normal")
    with pytest.raises(Exception, match="several lengths: 1"):
        read_bam_contigs(spark, str(tmp_path)).collect()


def reads_table(spark, n, span):
    """Reads of 10 to 60 000 positions, some without a cigar, over few bins."""
    cigar = F.when(F.col("id") % 7 == 0, F.concat((F.col("id") % 60_000).cast("string"), F.lit("N5M"))).when(F.col("id") % 11 == 0, "*").otherwise("10M")
    return spark.range(n).select(
        F.col("id"), F.lit("1").alias("chrom"), (F.xxhash64("id") % span).cast("int").alias("pos"), cigar.alias("cigar"), F.lit("ACGT").alias("seq")
    )


@pytest.mark.parametrize("limit", [sizing.BROADCAST_BYTES, -1])
@pytest.mark.parametrize("shift", [14, 6])
def test_dense_regions(spark, limit, shift):
    """Thousands of pieces in a bin, long ones over many bins, nested, touching, empty and inverted ones."""
    draw = np.random.default_rng(shift)
    rows = [("1", 2 * int(i), 2 * int(i) + 1) for i in draw.choice(8192, 6000, replace=False)]
    rows += [("1", int(s), int(s + n)) for s, n in zip(draw.integers(0, 400_000, 60), draw.choice([-5, 0, 3, 700, 40_000], 60))]
    rows += [("2", 0, 2**31 - 1 if shift == 14 else 5000), ("1", 395_000, 395_001), ("1", 395_001, 395_002)]
    regions = spark.createDataFrame(rows, "chrom string, start int, end int")
    reads = reads_table(spark, 3000, 450_000).unionAll(reads_table(spark, 500, 17_000).withColumn("id", F.col("id") + 10_000))
    real = np.array([(s, e) for c, s, e in rows if c == "1" and s < e])
    want = []
    for r in reads.collect():
        end = r.pos + sum(n for n, op in brute.operations(r.cigar) if op in "MDN=X") if r.cigar != "*" else r.pos + 1
        if ((real[:, 0] < end) & (real[:, 1] > r.pos)).any():
            want.append(r.id)
    hit = ranges.in_regions(reads, regions, limit=limit, shift=shift)
    assert sorted(r.id for r in hit.collect()) == sorted(want) and 0 < len(want) < 3500
    assert hit.columns == reads.columns


def test_reads_are_not_spread(spark):
    """The semi join takes each read once: nothing on the reads' side makes rows."""
    regions = spark.range(1000).selectExpr("'1' AS chrom", "cast(id * 10 AS int) AS start", "cast(id * 10 + 5 AS int) AS end")
    plan = ranges.in_regions(reads_table(spark, 100, 10_000), regions)._jdf.queryExecution().optimizedPlan()
    lines = plan.toString().splitlines()
    assert "Join LeftSemi" in lines[1]
    left = [line for line in lines if line.startswith("   :")]
    assert left and not any("explode" in line for line in left)


def test_dense_bins_cost_like_sparse_ones(spark):
    reads = reads_table(spark, 200_000, 16_000).where("cigar <> '*'").cache()
    reads.count()
    took = {}
    for pieces in (20, 8000, 20, 8000):
        step = 16_000 // pieces
        regions = spark.range(pieces).selectExpr("'1' AS chrom", f"cast(id * {step} AS int) AS start", f"cast(id * {step} + 1 AS int) AS end")
        begin = time.perf_counter()
        assert ranges.in_regions(reads, regions).count() > 0
        took[pieces] = time.perf_counter() - begin
    reads.unpersist()
    assert took[8000] < 5 * took[20] + 1


def test_plans_are_built_without_a_job(spark, tmp_path):
    regions = str(tmp_path / "regions")
    table = spark.range(2000).selectExpr("'1' AS chrom", "cast(id * 10 AS int) AS start", "cast(id * 10 + 5 AS int) AS end")
    table.write.parquet(regions)
    reads, small = reads_table(spark, 100, 10_000), spark.read.parquet(regions)
    obs = reads.select("chrom", "pos")
    context = spark.sparkContext
    context.setJobGroup("planning", "plans only")
    try:
        ranges.in_regions(reads, small)
        pairs = ranges.overlap_pairs(reads, small)
        positions.at_positions(obs, small.select("chrom", F.col("start").alias("pos")))
        huge = spark.range(5_000_000).selectExpr("'1' AS chrom", "cast(id AS int) AS start", "cast(id + 1 AS int) AS end", "uuid() AS note")
        shuffled = ranges.overlap_pairs(reads, huge)
        assert list(context.statusTracker().getJobIdsForGroup("planning")) == []
    finally:
        context._jsc.sc().clearJobGroup()
    hinted = lambda df: "rightHint=(strategy=broadcast)" in df._jdf.queryExecution().optimizedPlan().toString()
    assert hinted(pairs) and not hinted(shuffled)
    assert sizing.is_small(small) and not sizing.is_small(huge)


def test_regions_that_end_before_they_start(spark):
    parse = lambda text: spark.range(1).select(parse_region(F.lit(text)).alias("r")).first().r
    for text in ("chr:100-", "chr:500-100", "chr:1,000-9"):
        with pytest.raises(Exception, match=f"malformed region: {text}"):
            parse(text)
    assert tuple(parse("chr:500-499")) == ("chr", 499, 499) and tuple(parse("chr:-5")) == ("chr", 0, 5) and tuple(parse("chr:7")) == ("chr", 6, None)


def test_regions_by_a_dictionary(spark):
    """Names with colons: the name before the interval if there is such a contig, else the whole string."""
    contigs = spark.createDataFrame([("chr1",), ("chr1:1-5",), ("HLA:x",), ("b:9-3",)], "chrom string")
    texts = ["chr1:1-5", "chr1:1-5:2-3", "HLA:x", "HLA:x:1,000", "b:9-3", " chr1 : 2 - 4 ", "chr1"]
    table = spark.createDataFrame([(t,) for t in texts], "region string")
    got = {r.region: (r.chrom, r.start, r.end) for r in ranges.resolve_regions(table, contigs).collect()}
    assert got == {
        "chr1:1-5": ("chr1", 0, 5), "chr1:1-5:2-3": ("chr1:1-5", 1, 3), "HLA:x": ("HLA:x", 0, None), "HLA:x:1,000": ("HLA:x", 999, None),
        "b:9-3": ("b:9-3", 0, None), " chr1 : 2 - 4 ": ("chr1", 1, 4), "chr1": ("chr1", 0, None),
    }
    for text, error in (("chr2:1-5", "unknown contig in region: chr2:1-5"), ("chr1:9-3", "malformed region: chr1:9-3")):
        with pytest.raises(Exception, match=error):
            ranges.resolve_regions(spark.createDataFrame([(text,)], "region string"), contigs).collect()
