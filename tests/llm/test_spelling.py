"""Spelling variants against plain comparison of all words."""

import zlib
from collections import Counter

import numpy as np
import pytest

from paircall.llm import spelling


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    found = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        found.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return found


def plain_counts(rows):
    counts = Counter()
    for doc, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "[" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("size", [20_000, 40, 3])
def test_against_all_pairs(spark, size):
    """Shards of any size, also leaves in blocks (many words of the same letters), give the same rows."""
    draw = np.random.default_rng(size)
    words = {"".join(draw.choice(list("abcÿ"), draw.integers(6, 9))) for _ in range(120)}
    words |= {"".join(draw.permutation(list("aabbcc"))) for _ in range(60)} | {"a" * 300, "a" * 301, "b" * 7000, "b" * 6999, "a" * 700}
    for word in sorted(words)[:60]:
        at = int(draw.integers(len(word)))
        words |= {word[:at] + word[at + 1 :], word[:at] + "e" + word[at:]}
    counts = {w: int(5 ** draw.integers(1, 5)) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(table, size).collect()} == plain_variants(counts)


def test_words_of_texts(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()] + [(i, "Straße Strasse STRASSE strassé étrange-étranges×x " * (i % 7)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(table).collect()} == plain_counts(rows)
    assert len(plain_counts(rows)) >= 4 and spelling.variants(spelling.word_counts(empty)).count() == 0
    assert spelling.variants(spelling.word_counts(edge)).count() == len(plain_counts(rows[: edge.count()]))


def test_groups_use_every_letter():
    totals = np.zeros(256, dtype=np.int64)
    totals[97:123] = np.arange(26, 0, -1)
    group = spelling.letter_groups(totals)
    weights = np.bincount(group, weights=totals, minlength=spelling.GROUPS)
    assert (weights > 0).all() and (np.diff(weights) <= 0).all()
