"""The near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import numpy as np
import pytest
from test_edges import ids

import corpus_pipeline
from paircall.llm import shingles
from paircall.llm.common import words


def plain_shingles(text):
    parts = words(text)
    size = min(5, len(parts))
    return {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} if parts else set()


def copies(draw):
    """Texts and copies of them, changed in ever more words; a chain of copies of copies; one large group."""
    texts = []
    for changes in range(12):
        for _ in range(8):
            base = [f"w{x}" for x in draw.integers(0, 5000, int(draw.integers(40, 160)))]
            copy = list(base)
            for at in draw.integers(0, len(copy), changes):
                copy[at] = f"v{draw.integers(0, 5000)}"
            texts += [" ".join(base), " ".join(copy)]
    for _ in range(6):
        copy = list(copy)
        copy[int(draw.integers(0, len(copy)))] = f"u{draw.integers(0, 5000)}"
        texts.append(" ".join(copy))
    base = [f"g{x}" for x in draw.integers(0, 5000, 100)]
    for i in range(60):
        copy = list(base)
        for at in draw.integers(0, 100, 1 + i % 3):
            copy[at] = f"h{draw.integers(0, 5000)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("block", [500, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    texts = copies(np.random.default_rng(5))
    sets = [plain_shingles(t) for t in texts]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * len(sets[i] | sets[j]) and top[i] != top[j]:
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    expected = [i for i in range(len(texts)) if top[i] == i]
    assert sorted(ids(kept)) == expected and len(expected) < len(texts) - 60


def test_grown_tests_every_pair():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.choice(12, 8, replace=False).astype(np.uint64)) for _ in range(40)]
    found = shingles.grown(np.arange(40), np.arange(40), sets)
    top = list(range(40))
    for node, to in found:
        assert shingles.similar(sets[node], sets[to])
        top = [top[to] if t == top[node] else t for t in top]
    assert all(top[i] == top[j] for i in range(40) for j in range(i) if shingles.similar(sets[i], sets[j]))


def test_rows_as_before(edge, empty):
    kept = shingles.one_of_each(edge)
    assert kept.columns == edge.columns and ids(kept)[2] == 0 and ids(kept)[1] == 1 and ids(kept)[11] == 2 and ids(kept)[3] == 1 and ids(kept)[4] == 0
    assert shingles.one_of_each(empty).count() == 0
