"""Every learned unit counts, also those that are not sent to the tasks."""

import math

import numpy as np
import pytest

from paircall.llm import language


def test_same_with_few_words_sent(spark, monkeypatch):
    texts = [(1, "haus baum haus wald", "de"), (2, "house tree house wood baum", "en"), (3, "casa bosque casa \u00e1rbol", "es"), (4, "haus", "de")]
    asked = [(10, "wald"), (11, "bosque haust"), (12, "zzz"), (13, "qaq house house \u00e1"), (14, "wood casa wald a"), (15, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    counts = {}  # (kind, unit, language)
    for _, text, lang in texts:
        for word in language.letter_words(text):
            for kind, unit in [(0, word), *((n, g) for n in range(1, 5) for g in language.grams(word, n))]:
                counts.setdefault(kind, {}).setdefault(unit, {}).setdefault(lang, 0)
                counts[kind][unit][lang] += 1
    names, tables = ["de", "en", "es"], []
    for kind in range(5):
        sums = [sum(c.get(x, 0) for c in counts[kind].values()) + 0.5 * len(counts[kind]) + 1 for x in names]
        values = [[math.log10((c.get(x, 0) + 0.5) / s) for x, s in zip(names, sums, strict=True)] for c in counts[kind].values()]
        tables.append(({u: i for i, u in enumerate(counts[kind])}, np.array(values)))
    whole = language.Model(names, tables)
    monkeypatch.setattr(language, "WORDS", 1)
    found = language.predict(spark.createDataFrame(asked, "doc_id long, text string"), language.learn(docs)).collect()
    for r in found:
        words = language.letter_words(dict(asked)[r.row.doc_id] or "")
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sums = whole.scores(words).sum(0, dtype=float)
        weights = np.exp((sums - sums.max()) * math.log(10) / math.sqrt(len(words)))
        assert r.lang_pred == names[int(sums.argmax())] and r.score == pytest.approx(1 / weights.sum(), rel=1e-5)
    assert len(found) == len(asked)
