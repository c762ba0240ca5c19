"""Texts, and pieces of long texts, that are white space only."""

import pytest

from paircall.llm import lm_scoring


@pytest.mark.parametrize("text, words", [(b" \t\n ", 0), (b"a" * (lm_scoring.LONG + 1) + b"\n", 1), (b" " * (lm_scoring.LONG + 1) + b" b", 1)])
def test_read_alone(ranks, text, words):
    lengths, sizes, ids, _, rare = lm_scoring._read(lm_scoring.Words(ranks), [text])
    assert sizes.tolist() == [words + 2] and lengths.tolist() == [len(ids)] and len(rare[0]) == words


def test_slices(spark, ranks):
    gap = " " * (lm_scoring.LONG + 1)
    docs = spark.createDataFrame([(f"a{gap}{gap} b{gap}",)], "text string").coalesce(1)
    assert len(lm_scoring.draw_slices(docs, ranks, 1.0).collect()) == 2
