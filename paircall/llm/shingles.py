"""Near-duplicates by shingles: texts are linked if the Jaccard similarity of their five-word shingles is 0.8 or more.

Equal texts (the same words in the same order, by a 64-bit hash) are merged first. Candidates come from two sources. One is
op8's: SimHash fingerprints, here of the same five-word shingles, linked at 4 or fewer differing bits by vantage-point
trees; each text of a fingerprint meets one text of it, and that one the first of its fingerprint's star. Most texts of a
similarity of 0.8 are further apart than any radius at which trees exclude much, so the other source has no bound on
bits: texts that share one of BANDS keys, each made of ROWS least hashes of the text's shingles; two texts of similarity
s share none with probability (1 - s**ROWS)**BANDS, which is below 1e-8 at 0.8 and less above. Every link of either
source is then decided by the exact similarity.

Candidates are tested in two rounds. The pairs by fingerprints go with the first one. First each text of a key against one text of that key, another one for each key;
this joins large groups of copies at a cost that grows with their size only. Keys whose texts are by then in several
components meet as a whole, once for each set of texts: their texts are gathered in blocks of BLOCK, every two blocks
in a task of their own, and all pairs of different components are compared. So no pair of candidates is left untested.

Defined results: null texts and texts without words are equal. A text of fewer than five words is one shingle. The
component's name is its smallest doc_id, null if it has none but null. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import carried, stored, texts_of, words
from .components import components
from .simhash import links as near_fingerprints
from .simhash import majority, shingle_hashes

SHINGLE, LEAST = 5, (4, 5)  # a pair is linked if what is shared is at least 4/5 of the union
BANDS, ROWS, SEED = 35, 4, 42
BLOCK, BLOCK_BYTES = 500, 4 << 20  # texts of a key that meet in one task, and their bytes; twice as many for two blocks
_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADDED = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX, _OWN = np.uint64(0x9E3779B97F4A7C15), _draw.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Sorted hashes of a text's shingles, each once."""
    parts = words(text)
    return np.unique(shingle_hashes(parts, SHINGLE)) if parts else np.empty(0, dtype="<u8")


def text_id(parts: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(parts).encode(), SEED)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a text from the hashes of its shingles."""
    least = np.full(BANDS * ROWS, (1 << 32) - 1, dtype=np.uint32)
    if len(hashes):
        hashes = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(hashes), 1024):
            least = np.minimum(least, (hashes[i : i + 1024] * _FACTORS[:, None] + _ADDED[:, None]).min(1))
    keys = _OWN.copy()
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * shared >= LEAST[0] * (len(a) + len(b) - shared)


def _identified(docs: DataFrame, columns: list[str], keys: bool = False, text: bool = False) -> DataFrame:
    """`row`, `id` of the text and, if asked for, its `keys` with its fingerprint `fp`, and its words as `text`."""
    rows = carried(docs, columns)
    shape = rows.select("row").schema.add("id", "long")
    shape = shape.add("keys", ArrayType(LongType())).add("fp", "long") if keys else shape
    shape = shape.add("text", "string") if text else shape

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [words(t) for t in texts_of(part)]
                found = {"row": part.column("row"), "id": pa.array(np.array([text_id(x) for x in lists], dtype=np.uint64).view(np.int64))}
                if keys:
                    flat, prints = np.empty((len(lists), BANDS), np.uint64), np.empty(len(lists), np.uint64)
                    for i, x in enumerate(lists):
                        hashes = shingle_hashes(x, SHINGLE) if x else np.empty(0, "<u8")
                        flat[i], prints[i] = band_keys(hashes), majority(hashes)
                    found["keys"] = pa.ListArray.from_arrays(np.arange(len(lists) + 1, dtype=np.int32) * BANDS, pa.array(flat.ravel().view(np.int64)))
                    found["fp"] = pa.array(prints.view(np.int64))
                if text:
                    found["text"] = pa.array([" ".join(x) for x in lists], pa.string())
                yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))

    return rows.mapInArrow(task, shape)


def _tested(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, to) of the pairs (a, b), a < b, that are similar."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            # Row by row: the strings of one pair at a time.
            sets = ([shingle_set(batch.column(c)[at].as_py()) for c in ("ta", "tb")] for at in range(batch.num_rows))
            yield batch.select(["b", "a"]).filter(pa.array([similar(a, b) for a, b in sets], pa.bool_())).rename_columns(["node", "to"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(task, "node long, to long")


def grown(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (node, to) between similar texts, tested for all pairs that are not in one component yet."""
    _, component = np.unique(roots, return_inverse=True)
    order, sizes = np.argsort(ids, kind="stable"), np.array([len(s) for s in sets], dtype=np.int64)
    # Postings: for each shingle the texts that hold it.
    tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    at = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[at], owners[at]
    found = []
    for i in order.tolist():
        if not (component != component[i]).any():
            break
        low, high = np.searchsorted(tokens, sets[i]), np.searchsorted(tokens, sets[i], side="right")
        long = high - low
        held = owners[np.arange(long.sum()) + np.repeat(low - np.cumsum(long) + long, long)]
        shared = np.bincount(held, minlength=len(sets))
        near = (LEAST[1] * shared >= LEAST[0] * (sizes + sizes[i] - shared)) & (component != component[i])
        for j in np.flatnonzero(near).tolist():
            if component[j] != component[i]:
                found.append((int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))))
                component[component == component[j]] = component[i]
    return found


def _met(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, to): links among the texts of each key, from (key, id, root, n), n texts in the key."""
    # A text's block is by its hash; each block meets every block of its key.
    sizes = mixed.join(texts.select("id", F.octet_length("text").cast("long").alias("size")), "id").groupBy("key").agg(F.sum("size").alias("size"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_BYTES)).cast("long")
    dealt = mixed.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "root")

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        links = grown(part["id"].to_numpy(np.int64), part["root"].to_numpy(np.int64), [shingle_set(t) for t in part["text"]])
        return pd.DataFrame(links, columns=["node", "to"], dtype=np.int64)

    return dealt.join(texts, "id").groupBy("key", "x", "y").applyInPandas(meet, "node long, to long")


def fingerprint_pairs(points: DataFrame) -> DataFrame:
    """(a, b), a < b: texts (id, fp) whose fingerprints are linked. One text stands for each fingerprint."""
    prints = stored(points.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    equal = points.select("id", "fp").join(prints, "fp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    ends = lambda name, to: prints.select(F.col("fp").alias(name), F.col("first").alias(to))
    near = near_fingerprints(prints.select("fp")).join(ends("node", "x"), "node").join(ends("to", "y"), "to")
    return equal.where("a != b").unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def links(docs: DataFrame, points: DataFrame) -> DataFrame:
    """(node, root) of all texts that have a similar one, for stored `points` (id, keys, fp) of the distinct texts of `docs`."""
    near = stored(fingerprint_pairs(points).distinct(), "near")
    bands = points.select("id", F.explode("keys").alias("key"))
    # Of each key one text, drawn by the key, and a sum that is equal for equal sets of texts.
    salted = F.struct(F.xxhash64("id", "key").alias("h"), "id")
    shared = bands.groupBy("key").agg(F.count("*").alias("n"), F.min(salted)["id"].alias("first"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("all"))
    shared = stored(shared.where("n > 1"), "keys")
    members = stored(bands.join(shared, "key"), "members")
    of_near = near.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = stored(members.select("id").unionByName(of_near).distinct(), "wanted")
    texts = _identified(docs, ["doc_id"], text=True).groupBy("id").agg(F.first("text").alias("text"))
    texts = stored(texts.join(wanted, "id", "left_semi"), "texts")
    pairs = members.where("id != first").select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b"))
    linked = stored(_tested(pairs.unionByName(near).distinct(), texts), "links")
    found = components(linked)
    # Keys with texts of several components, one key for each set of texts.
    sided = members.join(found, members["id"] == found["node"], "left").select("key", "id", "n", "all", F.coalesce("root", "id").alias("root"))
    sided = stored(sided, "sided")
    mixed = sided.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.first("n").alias("n"), F.first("all").alias("all")).where("low != high")
    once = mixed.groupBy("n", "all").agg(F.min("key").alias("key"))
    more = stored(_met(sided.join(once.select("key"), "key", "left_semi").select("key", "id", "root", "n"), texts), "links")
    return found if more.isEmpty() else components(linked.unionByName(more))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: the smallest doc_id, of rows that share it the one with the least hash of its text."""
    prints = _identified(docs, ["doc_id"], keys=True).select(F.col("row.doc_id").alias("doc_id"), "id", "keys", "fp")
    points = stored(prints.groupBy("id").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "points")
    found = links(docs, points)
    rooted = stored(points.join(found, points["id"] == found["node"], "left").select("id", "first", F.coalesce("root", "id").alias("root")), "rooted")
    names = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    # Only texts that hold their component's smallest doc_id can give its document.
    classes = stored(rooted.join(names, "root").where(F.col("first").eqNullSafe(F.col("component_id"))).select("id", "root", "component_id"), "classes")
    kept = _identified(docs, docs.columns).join(classes, "id").where(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    # Only rows that share a doc_id meet in a window, or those of a component without any doc_id.
    order = Window.partitionBy("root").orderBy(F.xxhash64("row.text"))
    return kept.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("row.*")
