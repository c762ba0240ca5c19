"""The prefix trie against plain dictionaries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from paircall.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    result = {}
    for c, mine in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        result[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    return result


def plain_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, inside in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(inside) - 1) * len(node[-1][1].encode()) if node else 0
    said = lambda node: hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], said(n)) for n, m in members.items()), key=str)


def found(table):
    return sorted((tuple(r[c] for c in COLUMNS) for r in table.collect()), key=str)


def conversations(seed):
    """Few different turns, so that paths branch and join; one hot first turn, copies, nulls, ties, a long one, negative ids."""
    draw = np.random.default_rng(seed)
    rows = []
    for c in range(-12, 150):
        for turn in range(int(draw.integers(0, 9))):
            rows.append((c, None if turn == 0 and c % 3 == 0 else turn, ["user", None, ""][int(draw.integers(3))], ["é", None, "b" * 7, ""][int(draw.integers(2 + 2 * (turn > 3)))]))
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(40) for t in range(9 if c % 5 == 0 else 12)]
    rows += [(2000, t, "user", "x") for t in range(300)] + [(2003, t, "user", "x") for t in range(290)] + [(2003, 5, "user", "x"), (None, 1, "user", "x"), (7, 2, "a", "t"), (7, 2, "a", "t")]
    return rows


@pytest.mark.parametrize("shard, block", [(4096, 4096), (2, 5), (7, 3)])
def test_against_dictionaries(spark, monkeypatch, shard, block):
    monkeypatch.setattr(pt, "BLOCK", block)
    monkeypatch.setattr(pt, "NODES", 20)
    rows = conversations(shard)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(pt.prefix_trie(*pt.rebuilt(pt.numbered(table)), shard=shard)) == plain_trie(plain_rebuilt(rows))


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(3, None, None, None)], [(c, 1, "u", "t") for c in range(1, 5)], [(5, 1, "u", "t"), (5, 1, "u", "t"), (6, 1, "u", "t")]])
def test_small_tables(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    wide = table.selectExpr("*", "1 AS node", "2 AS i", "3 AS size", "4 AS h")
    assert found(pt.prefix_trie(*pt.rebuilt(pt.numbered(wide)))) == plain_trie(plain_rebuilt(rows))


@pytest.mark.parametrize("deep", [0.3, 0.5, 0.9])
def test_findclose(deep):
    draw = np.random.default_rng(4)
    parents = np.array([-1, *(int(draw.integers(0, i)) if draw.random() > deep else i - 1 for i in range(1, 1500))])
    saved, lower = draw.integers(0, 9, 1500), draw.integers(0, 2, 1500) * draw.integers(1, 5, 1500)
    leaves, total = pt.subtree_sums(parents, saved, lower, lower * 3)
    want_leaves, want_total = [0] * 1500, [0] * 1500
    has_child = set(parents.tolist())
    for i in range(1499, -1, -1):
        want_leaves[i] += int(lower[i]) + (i not in has_child and not lower[i])
        want_total[i] += int(saved[i] + 3 * lower[i])
        if parents[i] >= 0:
            want_leaves[parents[i]] += want_leaves[i]
            want_total[parents[i]] += want_total[i]
    assert leaves.tolist() == want_leaves and total.tolist() == want_total


def test_digest_of_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(100).selectExpr("cast(if(id < 60, 'a', 'b') AS binary) AS node", "id - 50 AS conv_id")
        got = {bytes(r.node): r.ends_sha256 for r in pt.ends_digests(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    say = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {b"a": say(range(-50, 10)), b"b": say(range(10, 50))}
