"""What comes to the driver: the words that are sent, packed, and no side of a join."""

from collections import Counter

import numpy as np

from paircall.llm import language


def letters(i):
    return "".join(chr(97 + int(c)) for c in str(i))


def test_few_rows_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(letters(j) for j in range(i, 400, 2)), "xy"[i]) for i in range(2)], "doc_id long, text string, lang string")
    frame, got = type(docs), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: got.append(collect(self)) or got[-1])
    model = language.learn(docs)
    known, values = model.tables[0]
    assert set(known) == {letters(j) for j in range(400)} and values.shape == (400, 2) and values.dtype == np.float32
    assert max(map(len, got)) < 50
    monkeypatch.undo()
    each = {r["unit"]: r["scores"] for r in model.units[0].collect()}
    assert all(np.allclose(values[at], each[word], rtol=1e-6) for word, at in known.items())


def test_no_side_of_a_join_goes_through_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "haus baum wald", "de"), (2, "house tree wood", "en")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "haus woods"), (2, "zaz t"), (3, "tree house")], "doc_id long, text string")
    plans, store = [], language.stored

    def seen(df, *name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, *name)

    monkeypatch.setattr(language, "WORDS", 0)
    monkeypatch.setattr(language, "stored", seen)
    found = language.predict(asked, language.learn(docs))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
    assert Counter(r.row.doc_id for r in found.collect()) == {1: 1, 2: 1, 3: 1}
