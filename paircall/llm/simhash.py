"""SimHash near-duplicates, found with vantage-point trees over Hamming distance.

Fingerprints of equal texts are merged first: from there on the work is on distinct fingerprints. Two fingerprints at
`radius` or fewer bits are linked. Over all 64 bits, distances of unrelated texts gather around 32, so a tree would
send most fingerprints to both sides of a border. Bits are therefore cut into `segments`; if two fingerprints differ
in at most `radius` bits, some segment differs in at most radius // segments. Each segment has a tree of its own,
whose distances count that segment only: an inner node has a vantage point and a border, leaves are shards. A
fingerprint goes to every shard that the triangle inequality cannot exclude: on a side it is not on, it may have
partners only within radius // segments of the border. With 5 segments and radius 4 that is 0, so each fingerprint goes
to one shard per segment; with one segment it is the classical tree with overlapping shards.

Trees are fitted on at most SAMPLE fingerprints (their number of leaves is bounded by that), all fingerprints are sent
through them. As the input grows, so would shards, and with them the pairs to compare by the square. A shard of more
than SPLIT fingerprints is therefore cut again, by trees over the bits outside its segment: these are cut into
`segments` parts in turn, and of two fingerprints at `radius` or fewer bits some part differs in at most
radius // segments, so they meet in a shard of that part's tree. Two levels make some 500 * 500 shards of a segment and
a part. What then holds more than SHARD fingerprints is cut into blocks, and every two blocks meet in a task of their
own, so one dense group is no single task.

In a shard, groups grow from one fingerprint: the unvisited ones are ordered by their distance to the shard's vantage
point, and only a ring of them, by the triangle inequality, is compared with each visited one. What joins a group
leaves the unvisited, so a dense group of k costs k comparisons and not k * k. The links that come out form stars, one
per group; `components` joins the stars of all shards.

Defined results: a null text or one without words has fingerprint zero, linked like any other. component_id is the
smallest doc_id of the component, null if it has none but null. Rows that share a doc_id are documents of their own.
An empty table gives an empty result. Only `doc_id` and `text` are read; other columns travel in a struct.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_of, stored, text_or_empty, words
from .components import components

SHINGLE, RADIUS, SEGMENTS, SEED = 4, 4, 5, 42
SAMPLE, LEAF = 8192, 16  # fingerprints a tree is fitted on, and of these in a leaf
SHARD, SPLIT = 2000, 20_000  # fingerprints that meet at once, and of a shard that goes through second trees
BITS = 64
_DEALT = "tree int, leaf long, part int, inner long, fp long"


def shingle_hashes(parts: list[str], shingle: int) -> np.ndarray:
    """Hashes of the shingles of some words, one by one; of all words together where these are fewer."""
    import xxhash

    joined = " ".join(parts).encode()
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    size = min(shingle, len(parts))
    begins = np.concatenate([[0], gaps + 1])[: len(parts) - size + 1]
    ends = np.concatenate([gaps, [len(joined)]])[size - 1 :]
    cuts = map(joined.__getitem__, map(slice, begins.tolist(), ends.tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(SEED)), dtype="<u8", count=len(begins))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' hashes."""
    parts = words(text)
    return majority(shingle_hashes(parts, shingle)) if parts else 0


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a very long text must not make a large table of bits
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, columns: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: `row` (a struct of `columns`, by default doc_id) and fp, the fingerprint as a signed long."""
    rows = docs.select(row_of(columns or ["doc_id"]), text_or_empty().alias("text"))

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found.view(np.int64))], names=["row", "fp"])

    return rows.mapInArrow(task, rows.select("row").schema.add("fp", "long"))


def masks(segments: int, without: int = 0) -> list[int]:
    """Bit masks of the segments of all bits but those of `without`; neighbouring bits go to different segments."""
    bits = [b for b in range(BITS) if not without >> b & 1]
    return [sum(1 << b for b in bits[s::segments]) for s in range(segments)]


class Tree:
    """A vantage-point tree over the bits of a mask; `leaves` counts its shards."""

    def __init__(self, sample: np.ndarray, mask: int, seed: int):
        self.mask, self.nodes, self.leaves = np.uint64(mask), [], 0
        self.root = self._grow(sample, np.random.default_rng(seed), 0)

    def distance(self, points: np.ndarray, vantage: int) -> np.ndarray:
        return np.bitwise_count((points ^ np.uint64(vantage)) & self.mask).astype(np.int64)

    def _grow(self, points: np.ndarray, draw, depth: int) -> int:
        """The number of the node: an inner node (vantage, border, inside, outside), or ~leaf."""
        if len(points) > LEAF and depth < 40:
            for _ in range(8):  # a vantage point that splits well
                vantage = int(points[draw.integers(len(points))])
                away = self.distance(points, vantage)
                border = int(np.median(away))
                inside = away <= border
                if inside.all():
                    border -= 1
                    inside = away <= border
                if inside.any() and not inside.all():
                    at = len(self.nodes)
                    self.nodes.append(None)
                    self.nodes[at] = (vantage, border, self._grow(points[inside], draw, depth + 1), self._grow(points[~inside], draw, depth + 1))
                    return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def shards(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, leaf) for every leaf that may hold a partner within `reach`, the own one included."""
        found, todo = [], [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                found.append((at, np.full(len(at), ~node)))
                continue
            vantage, border, inside, outside = self.nodes[node]
            away = self.distance(points[at], vantage)
            todo += [(inside, at[away - reach <= border]), (outside, at[away + reach > border])]
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.empty(0, int), np.empty(0, int))


def stars(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) of the groups that `points` form by steps of at most `radius` bits."""
    signed = np.unique(points.view(np.int64))
    points = signed.view(np.uint64)
    away = np.bitwise_count(points ^ points[0]).astype(np.int64)
    order = np.argsort(away, kind="stable")
    points, signed, away = points[order], signed[order], away[order]
    waiting = np.arange(len(points))  # unvisited, by distance to the vantage point
    members, tops = [], []
    while len(waiting):
        group, todo = [], [waiting[0]]
        waiting = waiting[1:]
        while todo:
            at = todo.pop()
            group.append(at)
            low, high = np.searchsorted(away[waiting], [away[at] - radius, away[at] + radius + 1])
            ring = waiting[low:high]
            near = np.bitwise_count(points[ring] ^ points[at]) <= radius
            if near.any():
                todo += ring[near].tolist()
                waiting = np.concatenate([waiting[:low], ring[~near], waiting[high:]])
        if len(group) > 1:
            values = signed[group]
            top = values.min()
            members.append(values[values != top])
            tops.append(np.full(len(group) - 1, top))
    if not members:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(members), np.concatenate(tops)


def links(points: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(node, to): stars of near fingerprints, for a stored table of distinct `fp`."""
    reach = radius // segments
    # A bounded sample fits the trees; every fingerprint goes through them.
    sample = points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    trees = [Tree(sample, mask, seed) for seed, mask in enumerate(masks(segments))]

    def placed(part: pd.DataFrame):
        fps = part["fp"].to_numpy(np.int64)
        for number, tree in enumerate(trees):
            at, leaf = tree.shards(fps.view(np.uint64), reach)
            yield number, leaf, fps[at]

    def sizes(batches):
        for part in batches:
            for number, leaf, _ in placed(part):
                found, n = np.unique(leaf, return_counts=True)
                yield pd.DataFrame({"tree": number, "leaf": found, "n": n})

    counts = points.mapInPandas(sizes, "tree int, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    # At most one row per leaf, of which there are fewer than segments * SAMPLE. One segment leaves no bits to cut again.
    full = counts.where(F.col("n") > SPLIT).toPandas() if segments > 1 else pd.DataFrame({"tree": [], "leaf": []})
    full = {number: leaves.to_numpy(np.int64) for number, leaves in full.groupby("tree")["leaf"]}
    seconds = {t: [Tree(sample, mask, seed) for seed, mask in enumerate(masks(segments, int(trees[t].mask)))] for t in full}

    def deal(batches):
        for part in batches:
            for number, leaf, fps in placed(part):
                again = np.isin(leaf, full.get(number, []))
                yield pd.DataFrame({"tree": number, "leaf": leaf[~again], "part": -1, "inner": -1, "fp": fps[~again]})
                leaf, fps = leaf[again], fps[again]
                for piece, tree in enumerate(seconds.get(number, [])):
                    at, inner = tree.shards(fps.view(np.uint64), reach)
                    yield pd.DataFrame({"tree": number, "leaf": leaf[at], "part": piece, "inner": inner, "fp": fps[at]})

    def meet(_, part: pd.DataFrame) -> pd.DataFrame:
        node, to = stars(part["fp"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"node": node, "to": to})

    shard = ["tree", "leaf", "part", "inner"]
    dealt = points.mapInPandas(deal, _DEALT)
    large = dealt.groupBy(*shard).agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    # Each block meets every block of its shard; the pair is named by its two numbers.
    blocks = F.coalesce(F.ceil(F.col("n") / SHARD), F.lit(1)).cast("long")
    dealt = dealt.join(large, shard, "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(*shard, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    return dealt.groupBy(*shard, "a", "b").applyInPandas(meet, "node long, to long")


def near_duplicates(docs: DataFrame, columns: list[str] | None = None, radius: int = RADIUS, segments: int = SEGMENTS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: `row` (a struct of `columns`, by default all), fp, root and component_id.

    `root` is a fingerprint that names the component, also where no document has a doc_id.
    """
    columns = docs.columns if columns is None else columns
    named = fingerprints(docs, ["doc_id"], shingle).select(F.col("row.doc_id").alias("doc_id"), "fp")
    prints = stored(named, "prints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    found = components(links(points, radius, segments))
    # A component's root is a fingerprint; its name is the smallest doc_id of all its fingerprints.
    rooted = stored(points.join(found, points["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    names = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    classes = stored(rooted.join(names, "root").select("fp", "root", "component_id"), "classes")
    if columns == ["doc_id"]:
        return prints.join(classes, "fp").select(F.struct("doc_id").alias("row"), "fp", "root", "component_id")
    return fingerprints(docs, columns, shingle).join(classes, "fp").select("row", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One document of each component: the smallest doc_id, of rows that share it the one with the least hash of its text."""
    found = near_duplicates(docs, **settings).where(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    # Only rows that share a doc_id meet in a window, or those of a component without any doc_id.
    order = Window.partitionBy("root").orderBy(F.xxhash64("row.text"))
    return found.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, ["doc_id"])
    return found.select("row.doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
