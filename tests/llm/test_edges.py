"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing names and empty tables."""

from collections import Counter

import pytest
from llm_rows import rows
from pyspark.sql import functions as F

from paircall.llm import decontamination, language, line_dedup, lm_scoring, mixing, quality, simhash, suffix_dedup, token_records, topk

IDS = Counter(r[0] for r in rows())


def ids(found, column="doc_id"):
    return Counter(r[0] for r in found.select(column).collect())


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, None), (9, 1), (9, 0)], "doc_id long, label int")


def test_language(edge, empty):
    model = language.learn(edge)
    assert model.languages == ["en", "fr"]
    found = language.predict(edge, model)
    assert ids(found, "row.doc_id") == IDS
    for r in found.collect():
        if r.row.doc_id in (3, 4, 5, -5):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in language.predict(edge, language.learn(empty)).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_quality(spark, edge, empty):
    network, vectors = quality.fit(edge, labels(spark))
    found = quality.score(edge, network, vectors, edge.columns)
    assert ids(found, "row.doc_id") == IDS
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert found.select("row.*").columns == edge.columns
    nothing, vectors = quality.fit(empty, labels(spark))
    assert {r.score for r in quality.score(edge, nothing, vectors).collect()} == {0.5}
    assert quality.score(empty, network, vectors).count() == 0


def test_simhash(edge, empty):
    found = simhash.near_duplicates(edge)
    assert ids(found, "row.doc_id") == IDS
    by = {}
    for r in found.collect():
        by.setdefault(r.row.doc_id, set()).add((r.fp, r.component_id))
    assert {f for f, _ in by[3] | by[4] | by[5]} == {0} and {c for _, c in by[3] | by[4] | by[5]} == {3}
    assert {c for _, c in by[1] | by[2]} == {1}
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns and ids(kept)[2] == 0 and ids(kept)[1] == 1 and ids(kept)[11] == 2
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_simhash_only_null_ids(edge):
    kept = simhash.one_of_each(edge.where("doc_id IS NULL"))
    assert ids(kept) == Counter({None: 2})  # two components, one row each


def test_decontamination(spark, edge, empty):
    benchmark = spark.createDataFrame([(1, "seven wizards quietly mix nine jugs of old wine"), (2, None), (3, ""), (None, "word5 of5 word6")], "item_id long, text string")
    found = decontamination.find(edge, benchmark)
    assert Counter(r.row.doc_id for r in found.where("item_id = 1").collect()) == Counter({1: 1, 2: 2, None: 1})
    assert Counter(r.row.doc_id for r in found.where("item_id IS NULL").collect()) == Counter({6: 1, 7: 1})
    clean = decontamination.clean(edge, benchmark)
    assert clean.columns == edge.columns
    assert ids(clean) == IDS - Counter({1: 1, 2: 2, None: 1, 6: 1, 7: 1})
    assert decontamination.find(empty, benchmark).count() == 0
    assert decontamination.clean(edge, benchmark.limit(0)).count() == len(rows())


def test_suffix_dedup(edge, empty):
    found = suffix_dedup.deduplicate(edge)
    assert ids(found, "row.doc_id") == IDS
    by = {r.row.doc_id: r for r in found.collect()}
    assert by[1].n_removed == 0 and by[2].n_removed == by[2].n_bytes and by[None].n_removed == 0 and by[3].n_bytes == 0
    assert bytes(by[7].kept) == b" tail" and [tuple(s) for s in by[7].spans] == [(0, by[6].n_bytes)]
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_mixing(edge, empty):
    found = mixing.mix(edge)
    assert ids(found, "row.doc_id") == IDS
    assert all(r.taken == r.copies * r.size and r.copies <= 2 for r in found.collect())
    assert found.agg(F.sum("taken")).first()[0] <= found.select("row.source", "target").distinct().agg(F.sum("target")).first()[0]
    assert mixing.repeated(edge).columns == edge.columns
    assert mixing.mix(empty).count() == 0


def test_token_records(edge, empty, vocabulary):
    found = token_records.encode(edge, vocabulary)
    assert ids(found) == IDS
    assert [r.n_tokens for r in found.where("doc_id IN (3, 4)").collect()] == [1, 1]
    assert token_records.encode(empty, vocabulary).count() == 0


def test_lm_scoring(edge, empty, ranks):
    found = lm_scoring.score(edge, ranks)
    assert ids(found) == IDS
    by = {r.doc_id: r for r in found.collect()}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1 and by[3].score == by[4].score < 0
    assert by[6].n_tokens == 80_001
    assert lm_scoring.score(empty, ranks).count() == 0
    everything_out = lm_scoring.score(edge, ranks, F.lit(True))
    assert {(r.train_tokens, r.n_known) for r in everything_out.collect()} == {(0, 0)}


def test_line_dedup(edge, empty):
    found = line_dedup.deduplicate(edge, edge.columns)
    assert ids(found, "row.doc_id") == IDS
    by = {r.row.doc_id: r for r in found.collect()}
    assert by[9].n_removed == 0 and (by[10].n_lines, by[10].n_removed, by[10].kept) == (4, 3, "other")
    assert by[3].n_lines == 0 and by[3].kept is None and by[4].n_lines == 1
    assert line_dedup.deduplicate(empty).count() == 0


def test_topk(spark):
    data = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, []), (6, [2.0]), (7, [1e200, 0.0])]
    found = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=3)
    by = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    assert by[0, 1] == (7, 2**63 - 1) and by[0, 2] == (6, 2048 * 1024) and by[0, 3] == (100, 1024 * 1024)
    assert len(by) == 6
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("number", range(5))
def test_stages(spark, edge, empty, number, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "seven wizards quietly mix nine jugs of old wine")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark).withColumnRenamed("label", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[number]
    for docs in (edge, empty):
        found = stage(spark, docs, str(tmp_path))
        found.collect()
        if number < 4:
            assert found.columns == docs.columns and found.schema.simpleString() == docs.schema.simpleString()
