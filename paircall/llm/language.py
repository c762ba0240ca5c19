"""Language identification by word-first backoff.

Learning counts the words of each language and their character n-grams of four letters down to one (with marks at the
word's ends) over all texts with a language. All learned units count; they stay in a stored table. At most WORDS of the most
frequent words are sent to the tasks, for speed only; every other word of a text is looked up by a join. A document's
words are scored one by one: a known word by its log frequency in each language; an unseen one by the mean of its known
4-grams; if none is known, by 3-grams, and so on. The language with the highest sum wins. A document gives each of its
joined words once, with a count. Words that learning never saw may be in every document; an aggregation follows the
join, so Spark may split such a key (skew join).

The driver holds the words that are sent and no other rows: these come to it packed, a few rows for all, and no join sends
a side through it. Sizes of compressed files say little about the rows of words and n-grams that are made of them.

Counting runs in tasks that flush their counters when these are full, and Spark adds the parts up.

Defined results: `und` with score 0 for a null text, one without a letter, or a model without languages; of equal
sums the alphabetically first language wins. A word is a run of letters, in lower case. Rows that share a doc_id are
predicted on their own. Texts with a null language teach nothing. The score is the winner's share after a softmax of
the sums, divided by the root of the number of words. Only `text` and the named language column are read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from .common import row_of, stored, text_or_empty

WORDS, LONGEST = 60_000, 4  # words that are sent to the tasks
PACKED = 10_000  # of them in a row that goes to the driver
FLUSH = 400_000  # counters a task holds
DOCS = 256
UNKNOWN = "und"
RARE = StructType().add("word", StringType()).add("n", LongType())
_RUN = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    found = _RUN.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    # \w also holds numerals such as fractions; they separate words like any other sign.
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def count_words(docs: DataFrame, language: str) -> DataFrame:
    """(language, unit, n): how often each word occurs in the texts of each language."""

    def flush(counts: dict[str, Counter]) -> pd.DataFrame:
        names = [lang for lang, words in counts.items() for _ in range(len(words))]
        return pd.DataFrame({"language": names, "unit": [w for c in counts.values() for w in c], "n": [n for c in counts.values() for n in c.values()]})

    def task(batches):
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["language"], batch["text"], strict=True):
                counts.setdefault(lang, Counter()).update(letter_words(text))
                if sum(map(len, counts.values())) > FLUSH:
                    yield flush(counts)
                    counts = {}
        if any(counts.values()):
            yield flush(counts)

    texts = docs.where(F.col(language).isNotNull()).select(F.col(language).alias("language"), text_or_empty().alias("text"))
    parts = texts.mapInPandas(task, "language string, unit string, n long")
    return parts.groupBy("language", "unit").agg(F.sum("n").alias("n"))


def count_units(words: DataFrame) -> DataFrame:
    """(kind, language, unit, n) for n-grams of each length, from the counts of whole words; counts by batch, to be added."""

    def task(batches):
        for batch in batches:
            counts: dict[tuple[int, str], Counter] = {}
            for lang, word, c in batch.itertuples(index=False):
                for n in range(1, LONGEST + 1):
                    part = counts.setdefault((n, lang), Counter())
                    for gram in grams(word, n):
                        part[gram] += c
            for (n, lang), part in counts.items():
                yield pd.DataFrame({"kind": n, "language": lang, "unit": list(part), "n": list(part.values())})

    return words.select("language", "unit", "n").mapInPandas(task, "kind int, language string, unit string, n long")


class Model:
    """Log frequencies of units by language; `tables` has a dict from unit to row and a matrix for each kind.

    A learned model has the frequent words only in `tables`, and the scores of all units in `units` (kind, unit, scores).
    """

    def __init__(self, languages: list[str], tables: list[tuple[dict[str, int], np.ndarray]]):
        self.languages, self.tables, self.units = languages, tables, None

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: the word's own, or the mean of its known n-grams of the greatest length that has any."""
        found = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        known, values = self.tables[0]
        whole = [known.get(w, -1) for w in words]
        here = np.flatnonzero(np.array(whole, dtype=np.int64) >= 0)
        found[here] = values[[whole[i] for i in here]]
        left = [i for i, at in enumerate(whole) if at < 0]
        for n in range(LONGEST, 0, -1):
            known, values = self.tables[n]
            rows, sizes, scored, rest = [], [], [], []
            for i in left:
                own = [known[g] for g in grams(words[i], n) if g in known]
                if own:
                    rows += own
                    sizes.append(len(own))
                    scored.append(i)
                else:
                    rest.append(i)
            if scored:
                size = np.array(sizes)
                found[scored] = np.add.reduceat(values[rows], np.cumsum(size) - size, axis=0) / size[:, None]
            left = rest
        return found


def most_frequent(units: DataFrame, most: int) -> DataFrame:
    """The rows of highest `all`, at most `most` of them: whole levels of counts, eight to a doubling."""
    level = F.floor(F.log2("all") * 8)
    held, least = 0, None
    for row in sorted(units.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # some 500 at most
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    return units.where(F.lit(False) if least is None else level >= least)


def sent(rows: DataFrame, width: int) -> tuple[dict[str, int], np.ndarray]:
    """The words of (unit, scores) with their rows of a matrix; they reach the driver as a few packed rows."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                part = batch.slice(at, PACKED)
                values = part.column("scores").flatten().to_numpy().astype(np.float32)
                # Words are letters, so a line end is in none of them.
                yield pa.RecordBatch.from_pydict({"units": ["\n".join(part.column("unit").to_pylist())], "scores": [values.tobytes()]})

    parts = rows.select("unit", "scores").mapInArrow(pack, "units string, scores binary").collect()
    words = [w for part in parts for w in part["units"].split("\n")]
    values = np.frombuffer(b"".join(part["scores"] for part in parts), dtype=np.float32).reshape(-1, width)
    return {w: i for i, w in enumerate(words)}, values


def learn(docs: DataFrame, language: str = "lang") -> Model:
    words = stored(count_words(docs, language), "words")
    languages = sorted(row["language"] for row in words.select("language").distinct().collect())
    if not languages:
        return Model([], [])
    counts = words.select(F.lit(0).alias("kind"), "language", "unit", "n").unionByName(count_units(words))
    each = F.array(*(F.sum(F.when(F.col("language") == lang, F.col("n")).otherwise(0)) for lang in languages))
    units = stored(counts.groupBy("kind", "unit").agg(F.sum("n").alias("all"), each.alias("each")), "units")
    total = F.array(*(F.sum(F.col("each")[i]) for i in range(len(languages))))
    totals = {row["kind"]: row for row in units.groupBy("kind").agg(F.count("*").alias("units"), total.alias("total")).collect()}

    def scores(kind: int):
        size, total = (totals[kind]["units"], totals[kind]["total"]) if kind in totals else (0, [0] * len(languages))
        return F.array(*(F.log10((F.col("each")[i] + 0.5) / F.lit(n + 0.5 * size + 1)) for i, n in enumerate(total)))

    kinds = [units.where(F.col("kind") == kind).select("kind", "unit", "all", scores(kind).alias("scores")) for kind in range(LONGEST + 1)]
    model = Model(languages, [sent(most_frequent(kinds[0], WORDS), len(languages))])
    model.units = kinds
    return model


def _grams(n: int) -> Column:
    """The n-grams of `word`, as grams() has them; none if it is shorter."""
    marked = F.concat(F.lit("<"), "word", F.lit(">")) if n > 1 else F.col("word")
    begins = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(begins, lambda i: F.substring(marked, i, n))


def _shuffled(df: DataFrame) -> DataFrame:
    """As a side of a join: it is not collected on the driver, however small its files look."""
    return df.hint("merge")


def looked_up(words: DataFrame, model: Model) -> DataFrame:
    """(word, scores) for distinct `word`, from all learned units, and for the other learned words; no row for a word without any known unit.

    Words without a known n-gram of the greatest length, few in most texts, are joined with all shorter ones at once.
    """
    found = model.units[0].select(F.col("unit").alias("word"), "scores")
    left = stored(words.join(_shuffled(found.select("word")), "word", "left_anti"), "unseen")
    mean = F.array(*(F.avg(F.col("scores")[i]) for i in range(len(model.languages)))).alias("scores")

    def means(lengths: range) -> DataFrame:
        """(word, scores): the mean of its known n-grams of the greatest of these lengths that has any."""
        parts = reduce(DataFrame.unionByName, (left.select("word", F.lit(n).alias("kind"), F.explode(_grams(n)).alias("unit")) for n in lengths))
        units = reduce(DataFrame.unionByName, (model.units[n].select("kind", "unit", "scores") for n in lengths))
        by = _shuffled(parts).join(_shuffled(units), ["kind", "unit"]).groupBy("word", "kind").agg(mean)
        return by.groupBy("word").agg(F.max_by("scores", "kind").alias("scores"))

    looked = stored(left.join(_shuffled(means(range(LONGEST, LONGEST + 1))), "word", "left"), "looked")
    left = looked.where("scores IS NULL").select("word")
    return found.unionByName(looked.where("scores IS NOT NULL")).unionByName(stored(means(range(LONGEST - 1, 0, -1)), "looked"))


def predict(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """One row per document: `row` (a struct of `columns`, by default doc_id), lang_pred and score."""
    rows = docs.select(row_of(columns or ["doc_id"]), text_or_empty().alias("text"))
    width = len(model.languages)
    if not width:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shape = rows.select("row").schema.add("no", "long").add("words", "long").add("sums", ArrayType(DoubleType())).add("rare", ArrayType(RARE))
    shared = docs.sparkSession.sparkContext.broadcast(model.tables[0])  # bounded by WORDS

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        known, values = shared.value
        values = np.concatenate([values, np.zeros((1, width), dtype=np.float32)])  # the last row is for other words
        # Numbers rows; they are stored with the row, so a repeated task cannot disturb them.
        no = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                lists = [letter_words(t) for t in part.column("text").to_pylist()]
                sums, rare, ends = np.zeros((len(lists), width)), {"word": [], "n": []}, [0]
                for i, words in enumerate(lists):
                    ids = [known.get(w, -1) for w in words]
                    sums[i] = values[ids].sum(0, dtype=float) if ids else 0
                    own = Counter(w for w, at in zip(words, ids, strict=True) if at < 0)
                    rare["word"] += own.keys()
                    rare["n"] += own.values()
                    ends.append(len(rare["n"]))
                offsets = np.arange(len(lists) + 1, dtype=np.int32) * width
                pairs = pa.StructArray.from_arrays([pa.array(rare["word"], pa.string()), pa.array(rare["n"], pa.int64())], names=["word", "n"])
                made = [
                    part.column("row"), pa.array(np.arange(no, no + len(lists))), pa.array(np.array([len(x) for x in lists], dtype=np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                ]
                no += len(lists)
                yield pa.RecordBatch.from_arrays(made, names=["row", "no", "words", "sums", "rare"])

    found = stored(rows.mapInArrow(task, shape), "sums")
    rare = found.select("no", F.inline("rare"))
    scored = looked_up(rare.select("word").distinct(), model)
    more = _shuffled(rare).join(_shuffled(scored), "word").groupBy("no").agg(F.array(*(F.sum(F.col("scores")[i] * F.col("n")) for i in range(width))).alias("more"))
    both = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
    total = found.drop("rare").join(_shuffled(more), "no", "left").select("row", "words", both.alias("sums"))
    weights = F.transform("sums", lambda s: F.exp((s - F.array_max("sums")) * F.lit(float(np.log(10))) / F.sqrt("words")))
    share = 1 / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    names = F.array(*map(F.lit, model.languages))
    best = F.element_at(names, F.array_position("sums", F.array_max("sums")).cast("int"))
    some = F.col("words") > 0
    return total.select("row", F.when(some, best).otherwise(UNKNOWN).alias("lang_pred"), F.when(some, share).otherwise(0.0).alias("score"))


def held_out(column: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, learn(docs.where(~held_out())))
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
