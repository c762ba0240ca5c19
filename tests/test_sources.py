"""Readers and read operators."""

import gzip
import random
from collections import Counter

import bam_files
import brute
import pytest
from pyspark.sql import functions as F

from paircall.functions import flags, regions, tags
from paircall.operators import reads as ops
from paircall.sources import (
    read_bam,
    read_contigs,
    read_counts,
    read_fasta,
    read_positions,
    read_read_groups,
    read_sam,
)
from paircall.sources.bam import read_bam_contigs, read_bam_index_stats

HEADER = ["@HD\tVN:1.0", "@SQ\tSN:chrB\tLN:500", "@SQ\tSN:chrA\tLN:300", "@RG\tID:g1\tSM:x\tLB:lib1", "@RG\tID:g2", "@CO\tfree text"]


def sam_line(r, *tags):
    fields = [r["qname"], r["flag"], r["chrom"], r["pos"] + 1, r["mapq"], r["cigar"], "*", 0, 0, r["seq"] or "*", r["qual"] or "*", *tags]
    return "\t".join(map(str, fields))


def test_sam(spark, tmp_path):
    path = tmp_path / "x.sam"
    lines = [
        "a\t99\tchrA\t1\t10\t3M\t=\t200\t167\tAGc\t!!~\tNM:i:1\tRG:Z:g1\tXT:A:U\tNM:i:9",
        "b\t0x10\tchrB\t34\tbad\t*\tchrA\t0\t-5\tGCT\t*",
        "c\tpPr1\tother\t12abc\t300\t2M\t*\tx\tx\t*\t*\tRG:Z:none",
        "",
        "d\t0147\t*\t0\t0\t*\t*\t0\t0\tAC\t??",
    ]
    path.write_text("\n".join(HEADER + lines) + "\n")
    rows = {r.qname: r for r in read_sam(spark, str(path), "normal").collect()}
    assert set(rows) == set("abcd")
    a, b, c, d = (rows[k] for k in "abcd")
    assert (a.sample, a.flag, a.chrom, a.pos, a.mapq, a.cigar) == ("normal", 99, "chrA", 0, 10, "3M")
    assert (a.mate_chrom, a.mate_pos, a.isize, a.seq, a.qual) == ("chrA", 199, 167, "AGc", "!!~")
    assert a.tags == {"NM": "i:1", "RG": "Z:g1", "XT": "A:U"}
    assert (b.flag, b.pos, b.mapq, b.mate_pos, b.isize, b.qual, b.tags) == (16 | 4, 33, 0, -1, -5, None, None)
    assert (c.flag, c.pos, c.mapq, c.mate_pos, c.isize, c.seq) == (1 | 2 | 16 | 64, 11, 300 & 255, -1, 0, None)
    assert (d.flag, d.chrom, d.pos) == (0o147 | 4, "*", -1)

    contigs = read_contigs(spark, str(path))
    assert [tuple(r) for r in contigs.orderBy("tid").collect()] == [("chrB", 500, 0), ("chrA", 300, 1)]
    known = {r.qname: r.chrom for r in read_sam(spark, str(path), "normal", contigs).collect()}
    assert known == {"a": "chrA", "b": "chrB", "c": "*", "d": "*"}

    groups = read_read_groups(spark, str(path))
    assert {tuple(r) for r in groups.collect()} == {("g1", "lib1"), ("g2", None)}
    library = ops.with_library(read_sam(spark, str(path), "normal"), groups)
    assert {r.qname: r.library for r in library.collect()} == {"a": "lib1", "b": None, "c": None, "d": None}

    stats = ops.contig_stats(read_sam(spark, str(path), "normal", contigs), contigs)
    assert {tuple(r) for r in stats.collect()} == {("chrA", 300, 1, 0), ("chrB", 500, 0, 1), ("*", 0, 0, 2)}
    ops.require_contig(contigs, "chrA")
    with pytest.raises(ValueError):
        ops.require_contig(contigs, "zzz")


def test_sam_folder_and_gzip(spark, tmp_path):
    for i in range(2):
        with gzip.open(tmp_path / f"{i}.sam.gz", "wt") as f:
            f.write("\n".join([f"@SQ\tSN:c{i}\tLN:{i + 5}", "@SQ\tSN:both\tLN:9", f"r{i}\t0\tc{i}\t1\t1\t1M\t*\t0\t0\tA\tI"]) + "\n")
    assert {r.qname for r in read_sam(spark, str(tmp_path), "s").collect()} == {"r0", "r1"}
    assert {(r.chrom, r.length) for r in read_contigs(spark, str(tmp_path)).collect()} == {("c0", 5), ("c1", 6), ("both", 9)}


def test_validation(spark):
    good = dict(sample="s", qname="ok", flag=0, chrom="1", pos=1, mapq=1, cigar="2M", seq="AC", qual="II")
    bad = [
        good,
        good | dict(qname="", ),
        good | dict(qname="x", cigar="2M!"),
        good | dict(qname="x", cigar="2Q"),
        good | dict(qname="x", cigar="M2"),
        good | dict(qname="x", cigar="3M"),
        good | dict(qname="x", qual="I"),
        good | dict(qname="y", cigar="*", seq=None, qual=None),
        good | dict(qname="z", cigar="1m1i"),
    ]
    frame = brute.reads_frame(spark, bad).coalesce(1)
    errors = [r.error for r in ops.validate(frame).collect()]
    assert errors == [
        None, "missing read name", "invalid CIGAR character", "invalid CIGAR operation", "invalid CIGAR operation",
        "CIGAR and sequence length are inconsistent", "sequence and quality are inconsistent", None, None,
    ]
    fine, broken = ops.split_valid(frame)
    assert (fine.count(), broken.count()) == (3, 6)
    assert ops.strict(brute.reads_frame(spark, [good])).count() == 1
    with pytest.raises(Exception, match="bad record x: CIGAR and sequence length"):
        ops.strict(brute.reads_frame(spark, [bad[5]])).collect()


def test_regions_and_flags(spark):
    def parse(text):
        r = spark.range(1).select(regions.parse_region(F.lit(text)).alias("r")).first().r
        return r.chrom, r.start, r.end

    end = None
    assert parse("chr1") == ("chr1", 0, end)
    assert parse("chr1:1,001-2,000") == ("chr1", 1000, 2000)
    assert parse(" chr1 : 5 ") == ("chr1", 4, end)
    assert parse("HLA:A:10-20") == ("HLA:A", 9, 20)
    assert parse("HLA:x") == ("HLA:x", 0, end)
    assert parse("c:1-2-3") == ("c:1-2-3", 0, end)
    assert parse("c:0-4") == ("c", 0, 4)
    bins = spark.createDataFrame([(0, 1), (0, 1 << 29), (16383, 16385), (1 << 20, (1 << 20) + 70000)], "s long, e long")
    got = [r[0] for r in bins.coalesce(1).select(regions.genomic_bin(F.col("s"), F.col("e"))).collect()]
    assert got == [bam_files.bin_of(*x) for x in [(0, 1), (0, 1 << 29), (16383, 16385), (1 << 20, (1 << 20) + 70000)]]
    letters = spark.createDataFrame([(2047,), (0,), (1040,)], "f int").select(flags.flag_letters(F.col("f"))).collect()
    assert [r[0] for r in letters] == ["pPuUrR12sfd", "", "rd"]


def test_region_scan(spark):
    everything = brute.random_reads(300, 100)
    frame = brute.reads_frame(spark, everything)
    span = lambda r: r["pos"] + sum(n for n, op in brute.operations(r["cigar"]) if op in "MDN=X")
    got = Counter(r.qname for r in ops.in_region_string(frame, "2:21-40").collect())
    assert got == Counter(r["qname"] for r in everything if r["chrom"] == "2" and r["pos"] < 40 and span(r) > 20)


def test_regions_beyond_any_bin(spark):
    """No coordinate counts as the end of a contig."""
    far = dict(sample="normal", qname="far", flag=0, chrom="1", pos=600_000_000, mapq=9, cigar="5M", seq="ACGTA", qual="IIIII")
    frame = brute.reads_frame(spark, [far])
    for region, n in (("1", 1), ("1:1000", 1), ("1:1-1000", 0), ("1:600,000,005-600,000,010", 1), ("2", 0)):
        assert ops.in_region_string(frame, region).count() == n


def test_tag_edits(spark):
    frame = spark.createDataFrame([({"NM": "i:3", "RG": "Z:g"},)], "tags map<string,string>")
    t = F.col("tags")
    row = frame.select(
        tags.drop_tags(t, "NM").alias("a"), tags.keep_tag(t, "NM").alias("b"), tags.add_tag(t, "XX", "f", F.lit(1.5)).alias("c"),
        tags.add_tag(t, "NM", "i", F.lit(9)).alias("d"), tags.tag_int(t, "NM").alias("e"), tags.tag_int(t, "RG").alias("f"),
    ).first()
    assert (row.a, row.b, row.e, row.f) == ({"RG": "Z:g"}, {"NM": "i:3"}, 3, None)
    assert row.c["XX"] == "f:1.5" and row.d["NM"] == "i:3"


def test_positions_and_counts(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 1\n1\t6\n  2   2  \n\n1 1\nnot\n")
    assert {tuple(r) for r in read_positions(spark, str(tmp_path / "p.txt")).collect()} == {("1", 1, 0), ("1", 6, 5), ("2", 2, 1)}
    (tmp_path / "c.tsv").write_text("a_N\tb_N\ta_T\tb_T\textra\n1\t2\t3\t4\tx\n")
    counts = read_counts(spark, str(tmp_path / "c.tsv"), "csv")
    assert counts.dtypes[:4] == [(c, "bigint") for c in ("a_N", "b_N", "a_T", "b_T")] and counts.first().b_T == 4
    (tmp_path / "d.tsv").write_text("a_N\tb_N\n1\t2\n")
    with pytest.raises(ValueError, match="a_T, b_T"):
        read_counts(spark, str(tmp_path / "d.tsv"), "csv")


def sequences(frame):
    out = {}
    for r in frame.orderBy("chrom", "chunk_id").collect():
        assert r.chunk_start == len(out.get(r.chrom, ""))
        out[r.chrom] = out.get(r.chrom, "") + r.seq
    return out


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_fasta_by_scan(spark, tmp_path, piece, newline):
    rng = random.Random(piece)
    want = {f"c{i}": "".join(rng.choice("ACGTacgtN") for _ in range(n)) for i, n in enumerate((0, 1, 59, 60, 61, 200))}
    text = "".join(f">{name} some words{newline}" + "".join(s[i:i + 20] + newline for i in range(0, len(s), 20)) for name, s in want.items())
    path = tmp_path / "r.fa"
    path.write_bytes(text.rstrip().encode())
    got = read_fasta(spark, str(path), chunk=8, piece_bytes=piece)
    assert sequences(got) == {k: v for k, v in want.items() if v}
    assert all(len(r.seq) == 8 for r in got.collect() if r.chunk_start + 8 <= len(want[r.chrom]))


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_fasta_with_index(spark, tmp_path, piece):
    rng = random.Random(1)
    want = {"1": "".join(rng.choice("ACGTacgt") for _ in range(545)), "2": "".join(rng.choice("ACGT") for _ in range(60))}
    path, index, offset, text = tmp_path / "r.fa", [], 0, ""
    for name, s in want.items():
        text += f">{name}\n"
        index.append(f"{name}\t{len(s)}\t{len(text)}\t60\t61")
        text += "".join(s[i:i + 60] + "\n" for i in range(0, len(s), 60))
    path.write_text(text)
    (tmp_path / "r.fa.fai").write_text("\n".join(index) + "\n")
    assert sequences(read_fasta(spark, str(path), chunk=16, piece_bytes=piece)) == want


@pytest.fixture(scope="module")
def bam(tmp_path_factory):
    reads = brute.random_reads(900, 100_000, contigs=("1", "2"))
    for i, r in enumerate(reads):
        r["sample"] = "normal"
        if r["chrom"] == "*":
            r["pos"], r["flag"] = -1, 4
        if i % 40 == 0:
            r["cigar"], r["seq"], r["qual"] = "6M30000N6M", "ACGTACGTACGT", "I" * 12
    path = str(tmp_path_factory.mktemp("bam") / "n.bam")
    bam_files.write(path, reads, ["1", "2", "3"], [200_000] * 3, brute.operations)
    return path, reads


def key(r):
    seq = "".join(c.upper() if c.upper() in brute.CODES else "N" for c in r["seq"]) if r["seq"] else None
    return r["qname"], r["flag"], r["chrom"], r["pos"], r["mapq"], r["cigar"], seq, r["qual"]


COLUMNS = ("qname", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual")


@pytest.mark.parametrize("split", [600, 4000, 1 << 30])
def test_bam(spark, bam, split):
    path, reads = bam
    frame = read_bam(spark, path, "normal", split_bytes=split)
    rows = frame.select(*COLUMNS).collect()
    assert Counter(map(tuple, rows)) == Counter(map(key, reads))
    assert (frame.rdd.getNumPartitions() > 4) == (split < 1 << 30)


def test_bam_header_tags_and_stats(spark, bam):
    path, reads = bam
    row = read_bam(spark, path, "normal", tags=True).first()
    assert row.tags == bam_files.TAGS and row.sample == "normal" and row.mate_chrom == "*"
    assert [tuple(r) for r in read_bam_contigs(spark, path).collect()] == [(c, 200_000, i) for i, c in enumerate("123")]
    stats = {r.chrom: (r.mapped, r.unmapped) for r in read_bam_index_stats(spark, path).collect()}
    for c in "123":
        mine = [r for r in reads if r["chrom"] == c]
        assert stats[c] == (sum(not r["flag"] & 4 for r in mine), sum(bool(r["flag"] & 4) for r in mine))


@pytest.mark.parametrize("region", [("1", 0, None), ("2", 0, 20_000), ("1", 40_000, 40_500), ("2", 99_000, 300_000), ("3", 0, 10)])
def test_bam_region(spark, bam, region):
    path, reads = bam
    chrom, start, end = region
    stop = lambda r: r["pos"] + sum(n for n, op in brute.operations(r["cigar"]) if op in "MDN=X")
    rows = read_bam(spark, path, "normal", region=region, split_bytes=600).select(*COLUMNS).collect()
    want = [r for r in reads if r["chrom"] == chrom and (end is None or r["pos"] < end) and (start == 0 or stop(r) > start)]
    assert Counter(map(tuple, rows)) == Counter(map(key, want))


def test_bam_regions(spark, bam):
    path, reads = bam
    wanted = [("1", 0, 900), ("1", 40_000, 40_500), ("2", 99_000, None), ("1", 40_200, 41_000)]
    stop = lambda r: r["pos"] + sum(n for n, op in brute.operations(r["cigar"]) if op in "MDN=X")
    rows = read_bam(spark, path, "normal", regions=wanted, split_bytes=600).select(*COLUMNS).collect()
    hit = lambda r, g: r["chrom"] == g[0] and (g[2] is None or r["pos"] < g[2]) and stop(r) > g[1]
    assert Counter(map(tuple, rows)) == Counter(map(key, [r for r in reads if any(hit(r, g) for g in wanted)]))


def test_bam_observations(spark, bam):
    """The plan that reads through the index gives what a full scan gives, from fewer splits."""
    from paircall.plans import bam_observations, paired_observations
    from paircall.plans.alignments import listed_regions
    from paircall.sources import bam as module

    path, reads = bam
    listed = spark.createDataFrame([("1", 10), ("1", 40_100), ("2", 99_050), ("9", 5)], "chrom string, pos int")
    halves = [read_bam(spark, path, s) for s in ("normal", "tumour")]
    for options in ({"chromosome": "2"}, {"positions": listed}, {"positions": listed, "chromosome": "1"}, {}):
        got = Counter(map(tuple, bam_observations(spark, path, path, split_bytes=600, **options).collect()))
        assert got == Counter(map(tuple, paired_observations(*halves, **options).collect())) and got
    size = [n for p, n in module.list_files(path)][0]
    splits = lambda regions: len(module.plan_splits(path, size, 600, regions))
    assert splits([("2", 0, None)]) < splits(None) / 2
    assert splits(listed_regions(listed.where("chrom <> '9'"))) < splits(None) / 2
    assert listed_regions(listed.where("chrom = '1'")) == [("1", 0, 16384), ("1", 32768, 49152)]
    assert sorted(listed_regions(listed, windows=2)) == [("1", 0, None), ("2", 0, None), ("9", 0, None)]
    with pytest.raises(ValueError, match="unknown contig: 9"):
        bam_observations(spark, path, path, chromosome="9")


def test_bam_unknown_contig(spark, bam):
    with pytest.raises(Exception, match="unknown contig: 9"):
        read_bam(spark, bam[0], "normal", region=("9", 0, 10)).count()


def test_bam_floats_and_folders(spark, tmp_path, monkeypatch):
    """Float tags read back to the stored value; files in folders below count; batches are bounded by bytes."""
    import numpy as np

    from paircall.sources import bam as module
    from paircall.sources.files import list_files, plain_uri

    for value in (0.123456789, 16777215.0, 1e-30, 0.5, 3.0):
        assert np.float32(module._number(np.float32(value), "f")) == np.float32(value)
        assert float(module._number(value, "d")) == value
    assert module._number(0.5, "f") == "0.5" and module._number(3.0, "d") == "3"
    for name in ("a=1/x.bam", "a=1/b=2/y.bam", "_hidden/z.bam", ".other/z.bam", "top.bam"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    assert [(p.removeprefix(str(tmp_path)), n) for p, n in list_files(str(tmp_path), (".bam",))] == [("/a=1/b=2/y.bam", 2), ("/a=1/x.bam", 2), ("/top.bam", 2)]
    assert plain_uri("s3a://bucket/key") == "s3://bucket/key" and plain_uri("hdfs://host/x") == "hdfs://host/x"


def test_bam_long_records(spark, tmp_path, monkeypatch):
    from paircall.sources import bam as module

    reads = brute.random_reads(60, 50, contigs=("1",), seed=4)
    for r in reads:
        r["sample"], r["chrom"] = "normal", "1"
        extra = 40_000
        r["cigar"], r["seq"], r["qual"] = f"{extra}M", "ACGT" * (extra // 4), "I" * extra
    path = str(tmp_path / "long.bam")
    bam_files.write(path, reads, ["1"], [100_000], brute.operations)
    monkeypatch.setattr(module, "BATCH_BYTES", 200_000)
    reader = module.BamReader({"path": path, "sample": "normal"})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(batches) > 10 and sum(b.num_rows for b in batches) == 60
    assert read_bam(spark, path, "normal").where("length(seq) = 40000").count() == 60


def test_bam_filters_on_one_frame(spark, bam):
    """A filter of one query must not reach the next one on the same DataFrame."""
    path, reads = bam
    frame = read_bam(spark, path, "normal", split_bytes=600)
    near = frame.where("chrom = '2' AND pos < 30000")
    assert Counter(r.qname for r in near.collect()) == Counter(r["qname"] for r in reads if r["chrom"] == "2" and r["pos"] < 30000)
    assert frame.count() == len(reads)
    parts = lambda **options: read_bam(spark, path, "normal", split_bytes=600, **options).rdd.getNumPartitions()
    assert parts(region=("2", 0, 30000)) < parts() / 2


def test_bam_needs_an_index(spark, tmp_path, bam):
    copy = tmp_path / "alone.bam"
    copy.write_bytes(open(bam[0], "rb").read())
    with pytest.raises(Exception, match="has no .bai index"):
        read_bam(spark, str(copy), "normal").count()


@pytest.mark.parametrize("split", [700, 3000, 1 << 30])
def test_bam_deep_position(spark, tmp_path, split):
    """All reads within one window: the index knows no record inside, yet the file is read by many tasks."""
    reads = brute.random_reads(800, 50, contigs=("1",), seed=9)
    for r in reads:
        r["sample"], r["chrom"] = "normal", "1"
    path = str(tmp_path / "deep.bam")
    bam_files.write(path, reads, ["1"], [1000], brute.operations)
    frame = read_bam(spark, path, "normal", split_bytes=split)
    assert Counter(map(tuple, frame.select(*COLUMNS).collect())) == Counter(map(key, reads))
    assert (frame.rdd.getNumPartitions() > 8) == (split < 1 << 30)
    part = read_bam(spark, path, "normal", region=("1", 20, 30), split_bytes=split)
    assert part.count() == sum(1 for r in reads if r["pos"] < 30 and r["pos"] + sum(n for n, op in brute.operations(r["cigar"]) if op in "MDN=X") > 20)


def test_bam_wrong_border_is_an_error(bam, monkeypatch):
    from paircall.sources import bam as module

    path, _ = bam
    _, first = module.read_bam_header(path)
    monkeypatch.setattr(module, "find_record", lambda *_: first + 7)
    with pytest.raises(ValueError, match="no record begins"):
        list(module.BamReader({"path": path}).read(module.BamSplit(path, first, -5000)))
