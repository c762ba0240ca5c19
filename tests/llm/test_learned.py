"""Trained operators: held-out results, gradients, probabilities that add up, and plain versions of the scores."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from paircall.llm import attention, language, lm_scoring, quality
from paircall.llm.common import words


def test_language_held_out(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    found = language.op2_language(spark, tables).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.doc_id: r.held_out for r in found} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found}
    out = [r for r in found if r.held_out]
    assert len(out) > 20 and sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_backs_off():
    tables = [({"haus": 0}, np.array([[-1.0, -3.0]])), ({"a": 0, "b": 1}, np.array([[-2.0, -2.5], [-4.0, -1.0]]))]
    tables += [({}, np.zeros((0, 2)))] * 2 + [({"<hau": 0, "haus": 1}, np.array([[-1.5, -2.0], [-2.5, -4.0]]))]
    model = language.Model(["de", "en"], tables)
    assert model.scores(["haus", "hau", "haust", "ab", "zzz"]).tolist() == [[-1, -3], [-1.5, -2], [-2, -3], [-3, -1.75], [0, 0]]


def test_quality_held_out(spark, tables):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    found = quality.op7_quality(spark, tables).collect()
    known = [r for r in found if r.doc_id in labels and r.held_out]
    assert len(known) > 10 and sum(r.predicted == labels[r.doc_id] for r in known) >= 0.9 * len(known)
    assert all(r.predicted == (r.score >= 0.7) for r in found)
    again = quality.op7_quality(spark, tables).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in found}


def test_context_sums(spark):
    texts = ["a b a, c", "b B!! a", ""]
    sums = quality.context_sums(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    expected, index = np.zeros_like(sums), quality.index_vectors()
    for text in texts:
        ids = quality.units(text, quality.Units())
        for i, a in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    expected[a] += index[ids[j]]
    assert (sums == expected).all()


@pytest.fixture(scope="module")
def model():
    draw = np.random.default_rng(0)
    vocabulary = attention.Vocabulary(draw.integers(0, 50, 3000).astype(float))
    return vocabulary, attention.Model.fresh(vocabulary)


def lines(sizes, seed=1):
    draw = np.random.default_rng(seed)
    return [draw.integers(0, attention.LEAVES, n).astype(np.int32) for n in sizes]


def test_slopes(model):
    wide = attention.Model(model[1].vector.astype(np.float64))
    parts = attention.blocks(lines([5, 40, 17, 2]))[:3]
    _, slope = wide.slopes(*parts)
    for name in attention.Model.SHAPES:
        weights, slopes = wide.parts[name], attention.Model(slope).parts[name]
        at = np.unravel_index(np.abs(slopes).argmax(), slopes.shape)
        was = weights[at]
        weights[at] = was + 1e-5
        up = wide.slopes(*parts)[0]
        weights[at] = was - 1e-5
        down = wide.slopes(*parts)[0]
        weights[at] = was
        assert (up - down) / 2e-5 == pytest.approx(slopes[at], rel=1e-3, abs=1e-9)


def plain(model, line):
    """Scores of one line, position by position."""
    p = {k: v.astype(float) for k, v in model.parts.items()}
    ask, key, value, own = (t.astype(float) for t in model.tables())
    out = []
    for i in range(len(line) - 1):
        begin = max(0, (i // attention.BLOCK - 1) * attention.BLOCK)
        seen = line[begin : i + 1]
        logits = key[seen] @ ask[line[i]] + p["far"][i - np.arange(begin, i + 1)]
        weights = np.exp(logits - logits.max())
        hidden = np.maximum(weights @ value[seen] / weights.sum() + own[line[i]], 0)
        total = np.empty(attention.LEAVES)
        outer = hidden @ p["cluster"] + p["cluster0"] + p["pair"][line[i]]
        outer -= np.log(np.exp(outer).sum())
        for c in range(attention.SIDE):
            inner = hidden @ p["member"][c] + p["member0"][c]
            total[c * attention.SIDE : (c + 1) * attention.SIDE] = outer[c] + inner - np.log(np.exp(inner).sum())
        assert np.exp(total).sum() == pytest.approx(1)
        out.append(total[line[i + 1]])
    return np.array(out)


def test_scores_once_and_causal(model, monkeypatch):
    _, net = model
    some = lines([50, 1, 2, 16, 17, 33, 100])
    monkeypatch.setattr(attention, "PASS", 3)
    inputs, targets, starts, owner = attention.blocks(some)
    found = net.scores(inputs, targets, starts)
    assert (targets >= 0).sum() == sum(len(x) - 1 for x in some)
    for i, line in enumerate(some):
        mine = found[owner == i][targets[owner == i] >= 0]
        assert np.allclose(mine, plain(net, line), atol=1e-4)


def test_leaf_shares(model):
    vocabulary, _ = model
    for leaf in range(attention.COMMON, attention.LEAVES):
        assert np.exp(vocabulary.share[vocabulary.leaf == leaf]).sum() == pytest.approx(1, rel=1e-4)
    assert (vocabulary.share[vocabulary.leaf < attention.COMMON] == 0).all()


def test_lm_scoring(spark, tables, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAVY", 50)  # most words take the join
    docs = {r.doc_id: words(r.text or "") for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = Counter(w for i, ws in docs.items() if not out[i] for w in [*ws, None])
    total = sum(counts.values())
    found = lm_scoring.op1_lm_scoring(spark, tables).collect()
    assert len(found) == len(docs)
    for r in found:
        line = [*docs[r.doc_id], None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in line)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(line), sum(counts[w] > 0 for w in line), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > 1.3 * sum(r.base_score for r in held)  # learned something even from 160 texts


def test_slices_cover_every_text(spark, ranks):
    texts = ["", "one", " ".join(map(str, range(1000)))]
    found = lm_scoring.draw_slices(spark.createDataFrame([(t,) for t in texts], "text string"), ranks, 1.0).collect()
    ids = [np.frombuffer(r.ids, "<u2") for r in found]
    assert len(ids) == 1 + 1 + 63 and sum(x[0] == lm_scoring.END for x in ids) == 3
    assert len(lm_scoring.draw_slices(spark.createDataFrame([(t,) for t in texts], "text string"), ranks, 0.0).collect()) == 3
