"""Training of the language model covers every token; fingerprints give candidates of the near-duplicate stage."""

import numpy as np

from paircall.llm import attention, lm_scoring, shingles


def test_whole_lines(ranks, monkeypatch):
    known = lm_scoring.Words(ranks)
    texts = [b"", b"one Two", b"three " * 50, b" \n"]
    [(ids, lengths)] = lm_scoring.whole_lines(known, texts)
    assert lengths.sum() == len(ids) and lengths.tolist()[0] == lengths.tolist()[3] == 2 and ids[0] == ids[1] == lm_scoring.END
    monkeypatch.setattr(lm_scoring, "LONG", 20)
    pieces = list(lm_scoring.whole_lines(known, texts))
    assert len(pieces) > 10
    # Without the first id of each line, all tokens are there once.
    rest = np.concatenate([ids[lengths[:2].sum() + 1 : lengths[:3].sum()]])
    assert np.concatenate([line[1:] for line, _ in pieces[1:]]).tolist() == rest.tolist()


def test_every_token_trains(spark, ranks):
    texts = [" ".join(f"w{i * k % 97}" for i in range(3000)) for k in range(1, 9)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = lm_scoring.count_words(docs)
    ids = lm_scoring.count_ids(counts, ranks)
    ids[lm_scoring.END] += len(texts)
    leaves = attention.Vocabulary(ids)
    tuned = lm_scoring.tuned_weights(docs, ranks, attention.Model.fresh(leaves), leaves).select("tokens").collect()
    assert sum(r.tokens for r in tuned) == ids.sum()


def test_fingerprints_give_candidates(spark):
    base = [f"w{i}" for i in range(400)]
    near, other = list(base), [f"v{i}" for i in range(400)]
    near[200] = "x"
    texts = [" ".join(t) for t in (base, near, other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [np.array([shingles.text_id(t.split())], np.uint64).view(np.int64)[0].item() for t in texts]
    # No two texts share a band key; the first two, and the third by mistake, have near fingerprints.
    points = spark.createDataFrame([(ids[0], [1, 2], 0), (ids[1], [3, 4], 15), (ids[2], [5, 6], 1)], "id long, keys array<long>, fp long")
    found = {(r.node, r.root) for r in shingles.links(docs, points.cache()).collect()}
    assert found == {(max(ids[:2]), min(ids[:2]))}
