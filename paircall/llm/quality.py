"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibration.

Word vectors come from the whole corpus. A text is a sequence of units (the letters of a word, its marks, and a sign
for words in capitals), each hashed to one of 2048 rows. Every row has a sparse random index vector; a row's context
vector is the sum of the index vectors of its neighbours at distances 1 and 2, over all texts. Tasks count neighbour
pairs and send one 2048 x 32 table each, which Spark adds up; the sums are whole numbers, so reruns agree exactly.

A document's features are the mean and the deviation of its units' vectors, how often units repeat, and its length. The network is fitted on the
driver to at most `sample` labelled rows (those with the smallest hashes), and a temperature is then fitted to a fifth
of them that the network has not seen, so that scores are probabilities. Scoring covers whole texts of all documents.

Defined results: null and empty texts have features zero and get the score the network gives these. Without labelled
rows of both kinds, or without documents, scores are the share of label 1 (0.5 without any). Null labels and labels of
null doc_ids are not used; if a doc_id has several labels, the smallest counts. Rows that share a doc_id are scored on
their own. Only `doc_id` and `text` are read; of `labels`, `doc_id` and the label.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, text_or_empty, texts_of

ROWS, DIM, REACH = 2048, 32, 2
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
MEMO = 200_000
DOCS = 256  # documents whose histograms are held at once
_UNITS = re.compile(r"[^\W_]+|[\W_]+")


class Units(dict):
    """The units of a white-space separated word, remembered; cleared when full."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = []
        for run in _UNITS.findall(word):
            if len(run) > 1 and run.isupper():
                found.append("^")
            found.append(run[:24].lower())
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = tuple(zlib.crc32(u.encode()) % ROWS for u in found)
        return value


def units(text: str, memo: Units) -> np.ndarray:
    return np.array([u for word in text.split() for u in memo[word]], dtype=np.int64)


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse rows: four entries of 32 are +1 or -1."""
    draw = np.random.default_rng(seed)
    table = np.zeros((ROWS, DIM))
    for row in table:
        row[draw.choice(DIM, 4, replace=False)] = draw.choice([-1.0, 1.0], 4)
    return table


def context_sums(docs: DataFrame) -> np.ndarray:
    """Context vectors over all texts, summed by Spark; ROWS x DIM numbers reach the driver, whatever the input."""

    def task(batches):
        import pyarrow as pa

        memo, pairs = Units(), np.zeros(ROWS * ROWS)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                for text in batch.column("text").slice(at, DOCS).to_pylist():
                    ids = units(text, memo)
                    for k in range(1, REACH + 1):
                        if len(ids) > k:
                            np.add.at(pairs, ids[:-k] * ROWS + ids[k:], 1)
        pairs = pairs.reshape(ROWS, ROWS)
        sums = pairs @ index_vectors() + pairs.T @ index_vectors()  # whole numbers, exact in doubles
        seen = np.flatnonzero(pairs.any(0) | pairs.any(1))
        if len(seen):
            rows = pa.array(sums[seen].astype(np.int64).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), rows], names=["row", "sums"])

    parts = docs.select(text_or_empty().alias("text")).mapInArrow(task, "row int, sums array<long>")
    added = parts.select("row", F.posexplode("sums")).groupBy("row", "pos").agg(F.sum("col").alias("total")).toArrow()
    table = np.zeros((ROWS, DIM))
    table[added.column("row").to_numpy(), added.column("pos").to_numpy()] = added.column("total").to_numpy()
    return table


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit-length context vectors beside the index vectors, which keep rows of like contexts apart."""
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.hstack([np.divide(sums, length, out=np.zeros_like(sums), where=length > 0), index_vectors() / 2.0])


def pooled(texts: list[str], vectors: np.ndarray, memo: Units) -> np.ndarray:
    """Means, deviations, shares of units equal to the one or two before, and log length; zeros for a text without units."""
    counts = np.zeros((len(texts), ROWS), dtype=np.float32)
    again = np.zeros((len(texts), REACH), dtype=np.float32)
    for i, text in enumerate(texts):
        ids = units(text, memo)
        counts[i] = np.bincount(ids, minlength=ROWS) if len(ids) else 0
        again[i] = [(ids[k:] == ids[:-k]).mean() if len(ids) > k else 0 for k in range(1, REACH + 1)]
    n = counts.sum(1, keepdims=True)
    share = counts / np.maximum(n, 1)
    mean = share @ vectors.astype(np.float32)
    square = share @ (vectors**2).astype(np.float32)
    # The deviation of few units is too small by about this factor.
    spread = np.sqrt(np.maximum(square - mean**2, 0) * n / np.maximum(n - 1, 1))
    return np.hstack([mean, spread, again, np.log1p(n) / 10])


class Network:
    """Two layers, fitted by Adam on whitened features, with a temperature; plain arrays, so it travels to tasks."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.constant = None if len(set(y.tolist())) > 1 else (float(y.mean()) if len(y) else 0.5)
        if self.constant is not None:
            return
        order = draw.permutation(len(x))
        held, fit = order[: len(x) // 5], order[len(x) // 5 :]
        self.center, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-4
        self.weights = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        self._fit(self._whiten(x[fit]), y[fit], draw)
        if len(set(y[held].tolist())) > 1:
            logits = self.logits(x[held])
            grid = np.geomspace(0.25, 8, 60)
            loss = [np.logaddexp(0, np.where(y[held] == 1, -logits, logits) / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _whiten(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -8, 8)

    def _fit(self, x: np.ndarray, y: np.ndarray, draw) -> None:
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(x))
            for i in range(0, len(x), BATCH):
                xb, yb = x[order[i : i + BATCH]], y[order[i : i + BATCH]]
                hidden = np.tanh(xb @ self.weights[0] + self.weights[1])
                error = (_sigmoid(hidden @ self.weights[2] + self.weights[3]) - yb) / len(xb)
                back = np.outer(error, self.weights[2]) * (1 - hidden**2)
                slopes = [xb.T @ back + DECAY * self.weights[0], back.sum(0), hidden.T @ error + DECAY * self.weights[2], error.sum(keepdims=True)]
                step += 1
                for w, g, m, v in zip(self.weights, slopes, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._whiten(x) @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def labelled(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `sample` rows. That bound also bounds the broadcast and what is collected."""
    some = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "text", "label")

    def task(batches):
        import pyarrow as pa

        memo = Units()
        for batch in batches:
            for i in range(0, batch.num_rows, DOCS):
                part = batch.slice(i, DOCS)
                x = pooled(part.column("text").to_pylist(), vectors, memo).astype("<f4")
                made = pa.array([row.tobytes() for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), made], names=["doc_id", "label", "x"])

    rows = rows.withColumn("label", F.col("label").cast("double")).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = rows.mapInArrow(task, "doc_id long, label double, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), "<f4").astype(float)
    return x.reshape(len(found), 2 * vectors.shape[1] + REACH + 1), found.column("label").to_numpy()


def score(docs: DataFrame, network: Network, vectors: np.ndarray, columns: list[str] | None = None) -> DataFrame:
    """One row per document: `row` (a struct of `columns`, by default doc_id) and `score`."""
    columns = ["doc_id"] if columns is None else columns
    # One structure for all other columns: their names cannot clash with the text's.
    rows = carried(docs, columns)
    shape = rows.select("row").schema

    def task(batches):
        import pyarrow as pa

        memo = Units()
        for batch in batches:
            for i in range(0, batch.num_rows, DOCS):
                part = batch.slice(i, DOCS)
                found = network.probability(pooled(texts_of(part), vectors, memo))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found.astype(float))], names=["row", "score"])

    return rows.mapInArrow(task, shape.add("score", "double"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Network, np.ndarray]:
    """The network and the word vectors. `labels` has doc_id and label; word vectors use the texts of all `docs`."""
    vectors = word_vectors(context_sums(docs))
    return Network(*labelled(docs, labels, vectors, sample)), vectors


def held_out(column: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_labels(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network, vectors = fit(docs, quality_labels(spark, sf_dir))
    found = score(docs, network, vectors)
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
