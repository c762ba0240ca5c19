"""Near-duplicates by odd sketches of MinHash samples.

A document is the set of its distinct five-word shingles; two are linked if at least SHARE of their union is shared.
Documents of equal sets (by a 128-bit digest) are one class, and all further work is on classes.

Each class has SAMPLES MinHash samples. BANDS keys of ROWS samples each bring candidates together: a pair of
similarity s has no key in common with probability (1 - s**ROWS)**BANDS, which is below 1e-8 at 0.85 and less above.
The samples are also folded into an odd sketch: a bitmap of BITS bits in which every sample flips one. The exclusive or
of two sketches is the odd sketch of the samples that differ, so its population count tells how many do: few bits mean a
high similarity, and the error is small just there. `limit` is the largest count that a pair at the threshold exceeds
with probability below MISS, by the exact distribution of the count. Candidates above it are not verified. All others
are confirmed on the full sets of shingle hashes.

Candidates are verified in two steps. First stars: in every key, each class against one class of that key, drawn by a
hash; of its candidates, a class takes the one with the fewest odd bits. Two rounds of this join groups of copies at a
cost that grows with their size only. Then the keys whose classes are still of several components are met as a whole:
their classes are dealt to blocks, bounded in number and bytes, and every two blocks meet in a task. There, sketches of
different components are compared, and a pair counts in the first band that both have in common, so it is verified
once. A first pass of that kind, on sketches alone, finds the classes that have such a partner; only their sets travel
in the second. What leaves a task are links that join components, fewer than it has classes.

Defined results: a null text, or one without words, has an empty set, is linked with nothing and is its own component,
named by its doc_id. A text of fewer than five words is one shingle. A component's name is its smallest doc_id, null if
it has none but null; `kept` compares the two as equal if both are null. Rows that share a doc_id are documents of their
own. An empty table gives an empty result. Only `doc_id` and `text` are read; other columns travel in a struct.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _UPPER, WORD, row_of, stored, text_or_empty, words
from .components import components
from .simhash import shingle_hashes

SHINGLE, SHARE = 5, (85, 100)  # a pair is linked if 100 * shared >= 85 * union
BANDS, ROWS, SEED = 40, 6, 12
SAMPLES, BITS, MISS = BANDS * ROWS, 512, 1e-9
WORDS = BITS // 64  # of a sketch
STARS = 2
BLOCK, BLOCK_BYTES = 1000, 4 << 20  # classes of a key, and bytes of their sets, in one of two blocks that meet
_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADDED = _draw.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_OWN = _draw.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SKETCH = [f"s{i}" for i in range(WORDS)]


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's shingles, each once."""
    parts = words(text)
    return np.unique(shingle_hashes(parts, shingle)) if parts else np.empty(0, dtype="<u8")


def samples(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of SAMPLES hash functions over the shingles."""
    least = np.full(SAMPLES, (1 << 32) - 1, dtype=np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 1024):
        least = np.minimum(least, (high[i : i + 1024] * _FACTORS[:, None] + _ADDED[:, None]).min(1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = _OWN[:BANDS].copy()
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Each sample flips the bit that its number and value point to."""
    mixed = (least ^ _OWN) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    flips = np.bincount((mixed % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view("<u8")


@functools.cache
def limit(share: float, miss: float = MISS) -> int:
    """The least count of odd bits that pairs of similarity `share` exceed with a probability below `miss`."""
    states, odd = np.arange(BITS + 1), np.zeros(BITS + 1)
    odd[0] = 1
    chance, counts = (1 - share), np.zeros(BITS + 1)
    weight = share**SAMPLES  # of no sample that differs; each one that does flips two bits
    for differ in range(SAMPLES + 1):
        counts += weight * odd
        weight *= (SAMPLES - differ) / (differ + 1) * chance / share
        for _ in range(2):
            up, down = odd * (BITS - states) / BITS, odd * states / BITS
            odd = np.concatenate([[0], up[:-1]]) + np.concatenate([down[1:], [0]])
    above = 1 - np.cumsum(counts) / counts.sum()
    return int(np.flatnonzero(above < miss)[0])


def similar(a: np.ndarray, b: np.ndarray, share: tuple[int, int] = SHARE) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return share[1] * shared >= share[0] * (len(a) + len(b) - shared)


def sketched(docs: DataFrame, columns: list[str], shingle: int = SHINGLE) -> DataFrame:
    """`row`, digest of the set (null: empty), n_shingles, text_key, keys of the bands and the sketch, one row per document."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, LongType

    text = text_or_empty()
    rows = docs.select(row_of(columns), text.alias("text"), F.unhex(F.md5(text)).alias("text_key"))
    shape = rows.select("row", "text_key").schema.add("digest", "binary").add("n_shingles", "long").add("keys", ArrayType(LongType()))
    for name in _SKETCH:
        shape = shape.add(name, "long")

    def task(batches):
        import xxhash

        for batch in batches:
            digests, sizes, keys, sketches = [], [], [], []
            for at in range(batch.num_rows):
                found = shingle_set(batch.column("text")[at].as_py(), shingle)
                least = samples(found)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sizes.append(len(found))
                keys.append(band_keys(least))
                sketches.append(odd_sketch(least))
            n = len(sizes)
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(np.array(keys, dtype=np.uint64).reshape(-1).view(np.int64)))
            bits = np.array(sketches, dtype=np.uint64).reshape(n, WORDS).view(np.int64)
            made = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists, *(pa.array(np.ascontiguousarray(c)) for c in bits.T)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text_key"), *made], names=["row", "text_key", "digest", "n_shingles", "keys", *_SKETCH])

    return rows.mapInArrow(task, shape)


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, held): the sorted shingle hashes of the wanted classes (id, text_key)."""
    texts = docs.select(F.unhex(F.md5(text_or_empty())).alias("text_key"), text_or_empty().alias("text"))
    texts = texts.join(wanted, "text_key").groupBy("id").agg(F.first("text").alias("text"))

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            held = [shingle_set(batch.column("text")[at].as_py(), shingle).tobytes() for at in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held, pa.binary())], names=["id", "held"])

    return texts.mapInArrow(task, "id long, held binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(node, to) of the pairs (a, b) that are similar, node > to."""
    left = sets.select(F.col("id").alias("a"), F.col("held").alias("held_a"))
    right = sets.select(F.col("id").alias("b"), F.col("held").alias("held_b"))

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            held = [batch.column(c) for c in ("held_a", "held_b")]
            real = [similar(*(np.frombuffer(c[at].as_buffer(), "<u8") for c in held), share) for at in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(real, pa.bool_()))

    found = pairs.join(left, "a").join(right, "b").select("a", "b", "held_a", "held_b").mapInArrow(task, "a long, b long")
    return found.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to"))


def _rooted(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def close_pairs(sketches: np.ndarray, keys: np.ndarray, band: int, roots: np.ndarray, sides: np.ndarray, most: int):
    """(i, others): classes of different components and at most `most` odd bits, whose first common band is `band`.

    `sides` are 0 and 1 for two blocks that meet, or all 0 for a block by itself; two blocks meet across only.
    """
    across = bool(sides.any())
    for i in range(len(sketches)):
        if across and sides[i]:
            continue
        others = np.flatnonzero((sides == 1) if across else np.arange(len(sketches)) > i)
        others = others[roots[others] != roots[i]]
        odd = np.bitwise_count(sketches[others] ^ sketches[i]).sum(1, dtype=np.int64)
        others = others[odd <= most]
        others = others[~(keys[others, :band] == keys[i, :band]).any(1)]
        if len(others):
            yield i, others


def _arrays(part):
    keys = np.array(part["keys"].to_pylist(), dtype=np.int64).reshape(part.num_rows, BANDS)
    sketches = np.stack([part[c].to_numpy() for c in _SKETCH], axis=1).view(np.uint64)
    return sketches, keys, part["band"][0].as_py(), part["root"].to_numpy(), part["side"].to_numpy()


def _met(members: DataFrame, classes: DataFrame, sets: callable, share: tuple[int, int], most: int) -> DataFrame:
    """(node, to): links between the components of each key, from (key, band, id, root, blocks)."""
    # Each block meets every block of its key; a class's block is by its hash.
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sided = (F.col("own") > F.col("other")).cast("long").alias("side")
    dealt = dealt.select("key", "band", "id", "root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), sided)
    shown = dealt.join(classes.select("id", "keys", *_SKETCH), "id")

    def look(part):
        near = np.zeros(part.num_rows, dtype=bool)
        for i, others in close_pairs(*_arrays(part), most):
            near[i] = True
            near[others] = True
        return part.select(["key", "band", "x", "y", "side", "id", "root"]).filter(near)

    def meet(part):
        import pyarrow as pa

        arrays = _arrays(part)
        roots, ids, held = np.array(arrays[3]), part["id"].to_numpy(), part["held"].combine_chunks()
        held = [np.frombuffer(h.as_buffer(), "<u8") for h in held]
        found = []
        for i, others in close_pairs(*arrays[:3], roots, arrays[4], most):
            for j in others.tolist():
                if roots[i] != roots[j] and similar(held[i], held[j], share):
                    found.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                    roots[roots == roots[j]] = roots[i]
        links = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"node": links[:, 0], "to": links[:, 1]})

    kinds = "key long, band int, x long, y long, side long, id long, root long"
    close = stored(shown.groupBy("key", "x", "y").applyInArrow(look, kinds), "close")
    full = close.join(classes.select("id", "keys", *_SKETCH), "id").join(sets(close.select("id").distinct()), "id")
    return full.groupBy("key", "x", "y").applyInArrow(meet, "node long, to long")


def links(docs: DataFrame, classes: DataFrame, share: tuple[int, int] = SHARE, shingle: int = SHINGLE) -> DataFrame:
    """(node, root) of all classes that are linked to a smaller one, for stored classes (id, keys, sketch, text_key, n_shingles)."""
    most = limit(share[0] / share[1])
    bands = classes.select("id", "n_shingles", F.posexplode("keys").alias("band", "key"))
    anchor = F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"]
    keys = bands.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), anchor.alias("anchor")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") * 8 / BLOCK_BYTES)).cast("long")
    keys = stored(keys.select("key", "anchor", blocks.alias("blocks")), "keys")
    members = stored(bands.drop("n_shingles").join(keys, "key"), "members")
    sketch = classes.select("id", *_SKETCH)

    def sets(ids: DataFrame) -> DataFrame:
        return stored(_sets(docs, classes.join(ids, "id", "left_semi").select("id", "text_key"), shingle), "sets")

    pairs = members.where("id != anchor").select(F.col("id").alias("a"), F.col("anchor").alias("b")).distinct()
    pairs = pairs.join(sketch.withColumnRenamed("id", "a"), "a").join(sketch.select(F.col("id").alias("b"), *(F.col(c).alias(f"o{c}") for c in _SKETCH)), "b")
    odd = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o{c}"))) for c in _SKETCH), F.lit(0))
    pairs = stored(pairs.select("a", "b", odd.alias("odd")).where(F.col("odd") <= most), "pairs")
    held = sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    linked = found = None
    for _ in range(STARS):
        open_pairs = pairs
        if found is not None:
            a, b = found.select(F.col("node").alias("a"), F.col("root").alias("ra")), found.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            open_pairs = pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
            open_pairs = open_pairs.select("a", "b", "odd")
        best = open_pairs.groupBy("a").agg(F.min(F.struct("odd", F.xxhash64("b").alias("h"), "b"))["b"].alias("b"))
        star = stored(_confirmed(best, held, share), "links")
        linked = star if linked is None else linked.unionByName(star)
        found = components(linked)
    # Keys whose classes are of several components yet.
    sided = stored(_rooted(members, found), "sided")
    mixed = sided.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    more = stored(_met(sided.join(mixed, "key", "left_semi"), classes, sets, share, most), "links")
    return found if more.isEmpty() else components(linked.unionByName(more))


def near_duplicates(docs: DataFrame, columns: list[str] | None = None, share: tuple[int, int] = SHARE, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: `row` (a struct of `columns`, by default doc_id), n_shingles, component_id, kept."""
    columns = ["doc_id"] if columns is None else columns
    prints = stored(sketched(docs, ["doc_id"] if columns == ["doc_id"] else ["doc_id", *(c for c in columns if c != "doc_id")], shingle), "prints")
    named = prints.where("digest IS NOT NULL").withColumn("doc_id", F.col("row.doc_id"))
    same = [F.first(c).alias(c) for c in ("n_shingles", "keys", *_SKETCH)]
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("text_key").alias("text_key"), *same)
    # The numbers are drawn once, when the table is written.
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    rooted = stored(_rooted(classes.select("id", "digest", "first"), links(docs, classes, share, shingle)), "rooted")
    names = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    told = stored(rooted.join(names, "root").select("digest", "component_id"), "told")
    rows = prints.select("row", "n_shingles", "digest").join(told, "digest", "left")
    name = F.when(F.col("digest").isNull(), F.col("row.doc_id")).otherwise(F.col("component_id"))
    return rows.select("row", "n_shingles", name.alias("component_id"), F.col("row.doc_id").eqNullSafe(name).alias("kept"))


def op12_odd_sketch(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("row.doc_id", "n_shingles", "component_id", "kept")


OP12_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
           range(1, greatest(len(w) - {SHINGLE - 2}, 2)), lambda i: md5(array_to_string(w[i:i + {SHINGLE - 1}], ' '))))) END AS held
  FROM d),
k AS (SELECT r, doc_id, len(held) AS n, md5(array_to_string(held, ',')) AS c, held FROM s),
c AS (SELECT c, any_value(n) AS n, any_value(held) AS held FROM k WHERE n > 0 GROUP BY c),
u AS (SELECT c, n, unnest(held) AS h FROM c),
p AS (
  SELECT a.c AS a, b.c AS b FROM u a JOIN u b ON a.h = b.h AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING {SHARE[1]} * count(*) >= {SHARE[0]} * (a.n + b.n - count(*))),
t AS (SELECT c AS a, c AS b FROM c UNION SELECT t.a, p.b FROM t JOIN p ON t.b = p.a),
m AS (SELECT t.a AS c, min(k.doc_id) AS component_id FROM t JOIN k ON t.b = k.c GROUP BY t.a)
SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.n = 0 THEN k.doc_id ELSE m.component_id END AS component_id,
       k.doc_id IS NOT DISTINCT FROM CASE WHEN k.n = 0 THEN k.doc_id ELSE m.component_id END AS kept
FROM k LEFT JOIN m ON k.c = m.c
"""
