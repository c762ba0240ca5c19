"""Odd sketches against brute-force Jaccard similarity."""

import numpy as np
import pytest
from test_shingles import copies, plain_shingles

from paircall.llm import odd_sketch


def plain_components(rows):
    """(n_shingles, component) of each row (doc_id, text)."""
    sets = [plain_shingles(t or "") for _, t in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and top[i] != top[j] and 100 * shared >= 85 * len(sets[i] | sets[j]):
                top = [top[j] if t == top[i] else t for t in top]
    names = {}
    for t, (doc, _) in zip(top, rows, strict=True):
        names[t] = min((x for x in (names.get(t), doc) if x is not None), default=None)
    return sorted(((doc, len(s), names[t], doc == names[t]) for t, s, (doc, _) in zip(top, sets, rows, strict=True)), key=str)


def found(docs, **settings):
    return sorted((tuple(r) for r in odd_sketch.near_duplicates(docs, **settings).select("row.doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("stars, block", [(2, 1000), (1, 3)])
def test_against_brute_force(spark, monkeypatch, stars, block):
    monkeypatch.setattr(odd_sketch, "STARS", stars)
    monkeypatch.setattr(odd_sketch, "BLOCK", block)
    texts = copies(np.random.default_rng(9))
    rows = list(enumerate([*texts, *texts[:40], None, "", " \n", "one two", "One two", "one two three four five"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain_components(rows)
    assert found(docs) == expected and sum(not r[3] for r in expected) > 80


def test_edge_rows(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert found(edge) == plain_components(rows)
    assert odd_sketch.near_duplicates(edge, edge.columns).select("row.*").columns == ["doc_id", *edge.columns[1:]]
    assert found(empty) == []


def test_limit_is_the_tail_of_the_counts():
    draw, most = np.random.default_rng(3), odd_sketch.limit(0.85, 1e-2)
    over = 0
    for _ in range(2000):
        one = draw.integers(0, 1 << 32, odd_sketch.SAMPLES, dtype=np.uint32)
        other = np.where(draw.random(len(one)) < 0.15, draw.integers(0, 1 << 32, len(one), dtype=np.uint32), one)
        over += int(np.bitwise_count(odd_sketch.odd_sketch(one) ^ odd_sketch.odd_sketch(other)).sum()) > most
    assert over < 40 and most < odd_sketch.limit(0.85) < odd_sketch.BITS // 2


def test_pair_is_met_in_its_first_band_only():
    keys = np.array([[1, 2, 3], [1, 2, 4], [9, 2, 3]])
    sketches, roots = np.zeros((3, 8), dtype=np.uint64), np.arange(3)
    met = [(band, i, j) for band in range(3) for i, others in odd_sketch.close_pairs(sketches, keys, band, roots, np.zeros(3, int), 10) for j in others.tolist()]
    # The caller gives a task only classes that share the band's key; here every band sees all three.
    assert (0, 0, 1) in met and (1, 0, 1) not in met and (2, 0, 1) not in met and (1, 0, 2) in met and (2, 0, 2) not in met
