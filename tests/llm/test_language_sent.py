"""The words that are sent to the tasks: the most frequent ones, never more than asked for."""

import pytest

from paircall.llm import language


@pytest.mark.parametrize("most, kept", [(0, 0), (1, 1), (3, 1), (4, 4), (9, 4), (10, 10), (100, 10)])
def test_most_frequent(spark, most, kept):
    counts = [1000, 40, 40, 40, 1, 1, 1, 1, 1, 1]
    units = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate(counts)], "unit string, all long")
    found = sorted(r["all"] for r in language.most_frequent(units, most).collect())
    assert found == sorted(counts[:kept])


def test_repeated_rare_words_and_rows(spark, monkeypatch):
    """A word that a document repeats counts each time; equal rows are predicted on their own."""
    docs = spark.createDataFrame([(1, "aa bb", "x"), (2, "aa cc cc", "y")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "aa cc cc bb"), (1, "aa cc cc bb"), (2, "bb bb cc")], "doc_id long, text string")
    sent = [(r.row.doc_id, r.lang_pred, round(r.score, 6)) for r in language.predict(asked, language.learn(docs)).collect()]
    monkeypatch.setattr(language, "WORDS", 0)
    joined = [(r.row.doc_id, r.lang_pred, round(r.score, 6)) for r in language.predict(asked, language.learn(docs)).collect()]
    assert sorted(sent) == sorted(joined) and len(sent) == 3
    assert [name for _, name, _ in sorted(joined)] == ["y", "y", "x"]
