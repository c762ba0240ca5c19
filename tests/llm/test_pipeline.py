"""The pipeline against a plain version, and the registered queries against their SQL."""

import numpy as np
import pytest
from test_brute import reachable
from test_shingles import plain_shingles

import corpus_pipeline
from paircall.llm import decontamination, mixing, quality, registry, simhash


def test_run(spark, tables, vocabulary):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    network, vectors = quality.fit(docs, quality.quality_labels(spark, tables))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    scores = network.probability(quality.pooled([t or "" for _, t in rows], vectors, quality.Units()))
    kept = [row for row, s in zip(rows, scores, strict=True) if s >= corpus_pipeline.ACCEPT]
    sets, tops = [plain_shingles(t or "") for _, t in kept], list(range(len(kept)))
    for i, one in enumerate(sets):
        for j in range(i):
            if tops[i] != tops[j] and 5 * len(one & sets[j]) >= 4 * len(one | sets[j]):
                low, high = sorted((tops[i], tops[j]))
                tops = [low if t == high else t for t in tops]
    assert len(set(tops)) < len(kept)
    kept = [row for i, row in enumerate(kept) if tops[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    finder = decontamination.Finder(items)
    kept = [row for row in kept if not finder.matches(row[1] or "")]
    assert 0 < len(kept) < len(rows)
    left = docs.where(docs.doc_id.isin([i for i, _ in kept]))
    copies = {r.row.doc_id: r.copies for r in mixing.mix(left, ["doc_id"]).collect()}
    plain = Tokenizer.from_file(vocabulary)
    plain.encode_special_tokens = True
    expected, at = [], 0
    for i, text in kept:
        for _ in range(copies[i]):
            n = len(plain.encode(text or "", add_special_tokens=False).ids) + 1
            expected.append((i, at, n))
            at += n
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in corpus_pipeline.run(spark, tables).collect()) == expected


def test_simhash_components(spark, tables):
    """The whole query against all pairs of fingerprints."""
    found = sorted(tuple(r) for r in simhash.op8_simhash(spark, tables).select("doc_id", "fingerprint", "component_id").collect())
    tops = reachable([int(f, 16) for _, f, _ in found], simhash.RADIUS)
    assert [found[t][0] for t in tops] == [c for _, _, c in found]


@pytest.mark.parametrize("name", registry.ORACLE)
def test_query_against_sql(spark, tables, name):
    from workload import compare

    found = {"QUERIES": registry.QUERIES, "ORACLE": registry.ORACLE}
    for key, value in found.items():
        setattr(compare, key, {**getattr(compare, key), **value})
    rows, problem = compare.difference(spark, compare.connect(tables), tables, name)
    assert rows > 0 and not problem


def test_entry_has_every_number():
    import __spark_entry__ as driver

    names = driver.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14)) and "pipeline" in names
    assert np.all([callable(f) for f in names.values()])
