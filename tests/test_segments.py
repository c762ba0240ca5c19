"""CIGAR expansion: running sums against a walk over the operations, and its cost."""

import time

import brute
import numpy as np
import pyarrow as pa
import pytest

from paircall.operators import pileup, segments


def walk(pos, cigar):
    """The definition, one operation after another."""
    found, ref, query = [], pos, 0
    ops = [(n, op.upper()) for n, op in brute.operations(cigar.upper())] if cigar not in (None, "*") else []
    for i, (n, op) in enumerate(ops):
        indel, rest = 0, ops[i + 1 :]
        if rest and rest[0][1] in "ID":
            indel = rest[0][0] * (1 if rest[0][1] == "I" else -1)
        elif rest and rest[0][1] == "P":
            for m, other in rest[1:]:
                if other in "MDN=X":
                    break
                indel += m if other == "I" else 0
        if op in "MDN=X":
            found.append({"ref": ref, "query": query, "len": n, "op": op, "indel": indel})
        ref += n if op in "MDN=X" else 0
        query += n if op in "MIS=X" else 0
    return found


def test_against_a_walk():
    draw = np.random.default_rng(2)
    cigars = ["*", "", "5M", "3S4M2I5M1P2I1P3I4M", "2M1P", "1P2M", "10h3m2n4M", "4M2D2I3P1I"]
    cigars += ["".join(f"{n}{op}" for n, op in zip(draw.integers(0, 1200, k), draw.choice(list("MIDNSHP=X"), k))) for k in draw.integers(1, 60, 300)]
    pos = draw.integers(0, 1 << 20, len(cigars))
    got = segments.segment_arrays(pa.array([*cigars, None]), pa.array([*pos.tolist(), 3], pa.int32()))
    assert got.to_pylist() == [*(walk(int(p), c) for p, c in zip(pos, cigars)), None]
    assert segments.segment_arrays(pa.array([], pa.string()), pa.array([], pa.int32())).to_pylist() == []


def test_text_that_is_no_operation_is_left_out():
    got = segments.segment_arrays(pa.array(["5M?3D2M", "M4M", "x7M"]), pa.array([1, 1, 1], pa.int32())).to_pylist()
    assert [[(s["ref"], s["len"], s["op"]) for s in r] for r in got] == [[(1, 5, "M"), (6, 3, "D"), (9, 2, "M")], [(1, 4, "M")], [(1, 7, "M")]]


def test_cost_is_linear_in_the_operations():
    took = {}
    for n in (500, 5000, 500, 5000):
        cigar = pa.array(["3M1I2M1D" * (n // 4)] * (200_000 // n))
        begin = time.perf_counter()
        segments.segment_arrays(cigar, pa.array([0] * len(cigar), pa.int32()))
        took[n] = time.perf_counter() - begin
    assert took[5000] < 3 * took[500] + 0.1


@pytest.mark.parametrize("operations", [5000])
def test_reads_with_thousands_of_operations(spark, operations):
    cigar = "3M1I2M1D" * (operations // 4)
    bases = sum(n for n, op in brute.operations(cigar) if op in "MIS=X")
    read = {"sample": "normal", "qname": "q", "flag": 0, "chrom": "1", "pos": 7, "mapq": 9, "cigar": cigar, "seq": "ACGT" * (bases // 4) + "A" * (bases % 4), "qual": "I" * bases}
    obs = pileup.expand(brute.reads_frame(spark, [read] * 40)).groupBy("pos", "base").count().collect()
    want = {}
    for s in walk(7, cigar):
        for i in range(s["len"]):
            want[s["ref"] + i] = read["seq"][s["query"] + i] if s["op"] == "M" else None
    assert {r["pos"]: r["base"] for r in obs} == want and all(r["count"] == 40 for r in obs)
