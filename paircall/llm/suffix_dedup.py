"""Substring de-duplication: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id.

Sorting every suffix of the corpus would shuffle the corpus many times over. Instead the strings that can be equal are
brought together first, and only what is still undecided is sorted.

1. Anchors. The anchor of a 50-byte string is the leftmost of its 16-byte grams with the least hash, so equal strings
   have equal anchors at equal places. Consecutive strings with one anchor form a run; a text has one run in about 18
   bytes. A run is named by the hash of its anchor and a 64-bit hash of all bytes its strings cover.
2. Runs meet by anchor. A task sends one entry per run and smallest document; its other documents with the same run
   are decided on the spot. Of equal runs, all but those of the smallest document go as a whole. An anchor in one
   document only is dropped. What remains open: an anchor with several different runs, which may share some strings.
   Only the smallest document of each run can still lose part of it, and only if another run of the anchor has the
   same eight bytes left or right of the anchor.
3. Those runs' bytes are fetched from their documents and refined, all runs with the same anchor and the same bytes on
   one side in one task (a frequent anchor among changing neighbours is no hot key). Each position gets the bucket of its 8-byte gram; buckets are refined to 16, 32 and 50 bytes by sorting on a position's bucket and
   the bucket at the later offset, each step reusing the updated buckets of the step before. Positions alone in their
   bucket are final and leave. In a bucket of 50 bytes all strings are equal; those above the smallest doc_id go.
4. Documents get their decisions back, by block; spans are merged and cut out.

Entries travel packed, by ranges of the anchor's hash and by blocks of documents, whose numbers follow the input. An
anchor of a hot passage sends one entry per task batch, run and range. Nothing is dropped or capped.

Defined results: texts are UTF-8 bytes, a null text is empty; texts shorter than 50 bytes stay whole. Rows that repeat
doc_id and text get equal results; equal doc_ids do not remove each other's bytes. A row without a doc_id neither loses
bytes nor removes others'. An empty table gives an empty result. Only `doc_id` and `text` are read; other columns
travel in a struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import row_of, stored, text_or_empty

LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1  # grams in a string
PART, CHUNK = 1 << 22, 1 << 20  # bytes of a text that are handled at once, bytes of several texts
RANGE, BLOCK = 1 << 23, 1 << 20  # bytes of input for each range of hashes and each block of documents
_P, _Q, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29)
ENTRY = np.dtype([("anchor", "<u8"), ("run", "<u8"), ("left", "<u2"), ("right", "<u2"), ("uid", "<i8"), ("doc", "<i8")])
NAME = np.dtype([("uid", "<i8"), ("run", "<u8")])
PIECE = np.dtype([("anchor", "<u8"), ("run", "<u8"), ("uid", "<i8"), ("doc", "<i8"), ("size", "<u2")])
CUT = np.dtype([("uid", "<i8"), ("run", "<u8"), ("first", "u1"), ("last", "u1")])
WHOLE, LEFT, RIGHT, SOME, TEXT, OPEN = range(6)  # kinds of packed rows
SIDES = {LEFT: "left", RIGHT: "right"}
_PACKED = "key long, kind int, data binary"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> _S)) * _P + (b ^ (b >> _S)) * _Q
    return (h ^ (h >> _S)) * _P


def words(data: bytes) -> np.ndarray:
    """The eight bytes from each position, as one number."""
    return np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,)) if len(data) > 7 else np.empty(0, np.uint64)


class Runs:
    """The runs of several texts: text number, first string, number of strings, place of the anchor, and their names."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        data = b"".join(texts)
        begins = np.cumsum(sizes) - sizes
        if len(data) < LENGTH:
            self.text = self.first = self.count = self.at = np.empty(0, np.int64)
            self.anchor = self.run = np.empty(0, np.uint64)
            self.left = self.right = np.empty(0, np.uint16)
            return
        eight = words(data)
        hashes = mix(eight[: len(data) - GRAM + 1], eight[8:])
        hashes ^= hashes >> np.uint64(32)
        # The place in the low bits makes equal hashes prefer the left one.
        least = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < WINDOW:
            least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
        owner = np.repeat(np.arange(len(texts)), sizes)
        starts = np.flatnonzero(owner[: len(least)] == owner[LENGTH - 1 : LENGTH - 1 + len(least)])
        at = (least[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
        fresh = np.flatnonzero(np.diff(at, prepend=-1) != 0)
        first, at = starts[fresh], at[fresh]
        count = np.diff(np.append(fresh, len(starts)))
        self.text, self.count = owner[first], count
        self.anchor = hashes[at]
        end = first + count + LENGTH - 1
        self.run = mix(self.anchor, (count * 64 + at - first).astype(np.uint64))
        for k in range(0, 2 * LENGTH - GRAM, GRAM):
            self.run = mix(self.run, hashes[np.minimum(first + k, end - GRAM)])
        self.left = self._side(eight, at - 8, at - 8 >= first)
        self.right = self._side(eight, at + GRAM, at + GRAM + 8 <= end)
        self.first, self.at = first - begins[self.text], at - begins[self.text]

    @staticmethod
    def _side(eight: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """A small hash of the eight bytes beside the anchor; 0 if a run has fewer there, which matches nothing."""
        value = eight[np.where(whole, at, 0)]
        return np.where(whole, (mix(value, value) >> np.uint64(48)).astype(np.uint16) | np.uint16(1), np.uint16(0))


def parts(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the parts of a text; each string of 50 lies in exactly one part."""
    for at in range(0, max(1, len(text) - LENGTH + 1), PART):
        yield at, text[at : at + PART + LENGTH - 1]


def chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Numbers of the texts, offsets and bytes of their parts, about CHUNK bytes at a time."""
    number, offset, held, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at, part in parts(text):
            number.append(i)
            offset.append(at)
            held.append(part)
            size += len(part)
            if size >= CHUNK:
                yield np.array(number), np.array(offset), held
                number, offset, held, size = [], [], [], 0
    if held:
        yield np.array(number), np.array(offset), held


def packed(key: np.ndarray, kind: int, rows: np.ndarray) -> pd.DataFrame:
    """One row per key with its records as bytes."""
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    begins = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.empty(0, np.int64)
    ends = np.append(begins[1:], len(key))[: len(begins)]
    data = [rows[a:b].tobytes() for a, b in zip(begins, ends, strict=True)]
    return pd.DataFrame({"key": key[begins], "kind": np.full(len(begins), kind, dtype=np.int32), "data": data})


def unpacked(part: pd.DataFrame, kind: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(part.loc[part["kind"] == kind, "data"]), dtype=dtype)


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) % np.uint64(ranges)).astype(np.int64)


def _block(uids: np.ndarray, blocks: int) -> np.ndarray:
    return (uids.view(np.uint64) % np.uint64(blocks)).astype(np.int64)


def smallest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts records by (anchor, run, doc); also says which have the smallest doc of their run."""
    rows = rows[np.lexsort((rows["doc"], rows["run"], rows["anchor"]))]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["run"][1:] != rows["run"][:-1])
    group = np.cumsum(fresh) - 1
    return rows, rows["doc"] == rows["doc"][np.flatnonzero(fresh)][group]


def entries(docs: DataFrame, ranges: int, blocks: int) -> DataFrame:
    """Packed entries by range, and by block the names of runs that are decided already (key: ranges + block)."""

    def task(batches):
        for batch in batches:
            texts = batch.column("data").to_pylist()
            doc, uid = batch.column("doc_id").to_numpy(), batch.column("uid").to_numpy()
            for number, _, held in chunks(texts):
                runs = Runs(held)
                if not len(runs.text):
                    continue
                own = number[runs.text]
                rows = np.empty(len(own), dtype=ENTRY)
                for name in ("anchor", "run", "left", "right"):
                    rows[name] = getattr(runs, name)
                rows["uid"], rows["doc"] = uid[own], doc[own]
                rows, least = smallest(rows)
                # A run that a document repeats is sent once.
                again = np.zeros(len(rows), dtype=bool)
                again[1:] = (rows["run"][1:] == rows["run"][:-1]) & (rows["anchor"][1:] == rows["anchor"][:-1]) & (rows["uid"][1:] == rows["uid"][:-1])
                rows, least = rows[~again], least[~again]
                yield packed(_range(rows["anchor"][least], ranges), OPEN, rows[least])
                yield packed(ranges + _block(rows["uid"][~least], blocks), WHOLE, _names(rows[~least]))

    return docs.where("doc_id IS NOT NULL").select("doc_id", "uid", "data").mapInArrow(_as_arrow(task), _PACKED)


def _as_arrow(task):
    def run(batches):
        import pyarrow as pa

        for table in task(batches):
            if len(table):
                yield pa.RecordBatch.from_pandas(table, schema=_packed_schema(), preserve_index=False)

    return run


def _packed_schema():
    import pyarrow as pa

    return pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def _names(rows: np.ndarray) -> np.ndarray:
    names = np.empty(len(rows), dtype=NAME)
    names["uid"], names["run"] = rows["uid"], rows["run"]
    return names


def meet(rows: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Of all entries of some anchors: names of the runs that go as a whole, and by side of those still open."""
    rows, least = smallest(rows)
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = rows["anchor"][1:] != rows["anchor"][:-1]
    group = np.cumsum(fresh) - 1
    whole = _names(rows[~least])
    rest, group = rows[least], group[least]
    ask = {}
    for kind, side in SIDES.items():
        # Open if another run of the anchor, with another document, has the same bytes on this side.
        order = np.lexsort((rest[side], group))
        g, s, d, r = group[order], rest[side][order], rest["doc"][order], rest["run"][order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        begins, sub = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        if len(begins):
            differs = np.minimum.reduceat(r, begins) != np.maximum.reduceat(r, begins)
            several = np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)
            order = order[(differs & several)[sub] & (s != 0)]
        ask[kind] = _names(rest[order])
    return whole, ask


def decide(found: DataFrame, ranges: int, blocks: int) -> DataFrame:
    """By block: names of the runs that go as a whole (WHOLE), and of those whose bytes are needed (LEFT, RIGHT)."""

    def group(key, part: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= ranges:
            return pd.DataFrame({"key": part["key"] - ranges, "kind": part["kind"], "data": part["data"]})
        whole, ask = meet(unpacked(part, OPEN, ENTRY))
        return pd.concat([packed(_block(n["uid"], blocks), kind, n) for kind, n in {WHOLE: whole, **ask}.items()])

    return found.groupBy("key").applyInPandas(group, _PACKED)


def _member(uids: np.ndarray, runs: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which (uid, run) are among the names."""
    wanted = np.unique(mix(names["uid"].view(np.uint64), names["run"]))
    return np.isin(mix(uids.view(np.uint64), runs), wanted)


def fetch(decided: DataFrame, docs: DataFrame, ranges: int, blocks: int) -> DataFrame:
    """By range: the bytes of the runs that are asked for."""
    texts = docs.where("doc_id IS NOT NULL").select(
        _block_column(blocks).alias("key"), F.lit(TEXT).alias("kind"), "data", "doc_id", "uid"
    )
    asked = decided.where(F.col("kind").isin(LEFT, RIGHT)).select("key", "kind", "data", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("uid"))

    def group(table):
        import pyarrow as pa

        kind = table.column("kind").to_numpy()
        names = {k: np.frombuffer(b"".join(table.column("data").filter(pa.array(kind == k)).to_pylist()), dtype=NAME) for k in SIDES}
        own = table.filter(pa.array(kind == TEXT))
        _, once = np.unique(own.column("uid").to_numpy(), return_index=True)
        wanted = np.concatenate([n["uid"] for n in names.values()])
        own = own.take(pa.array(once[np.isin(own.column("uid").to_numpy()[once], wanted)]))
        out = [packed(np.empty(0, np.int64), OPEN, np.empty(0, PIECE))]
        texts, uid, doc = own.column("data").to_pylist(), own.column("uid").to_numpy(), own.column("doc_id").to_numpy()
        for number, _, held in chunks(texts):
            runs = Runs(held)
            mine = number[runs.text]
            for side, named in names.items():
                some = np.flatnonzero(_member(uid[mine], runs.run, named))
                out.append(_pieces(runs, held, some, uid[mine[some]], doc[mine[some]], side, ranges))
        return pa.Table.from_pandas(pd.concat(out), schema=_packed_schema(), preserve_index=False)

    return texts.unionByName(asked).groupBy("key").applyInArrow(group, _PACKED)


def _pieces(runs: Runs, held: list[bytes], some: np.ndarray, uid: np.ndarray, doc: np.ndarray, side: int, ranges: int) -> pd.DataFrame:
    """The chosen runs with their bytes, by range of anchor and side; a run that a document repeats counts once."""
    _, once = np.unique(mix(uid.view(np.uint64), runs.run[some]), return_index=True)
    some, uid, doc = some[once], uid[once], doc[once]
    rows = np.empty(len(some), dtype=PIECE)
    rows["anchor"], rows["run"], rows["uid"], rows["doc"] = runs.anchor[some], runs.run[some], uid, doc
    rows["size"] = runs.count[some] + LENGTH - 1
    beside = getattr(runs, SIDES[side])[some].astype(np.uint64) + np.uint64(side << 16)
    keys = _range(mix(runs.anchor[some], beside), ranges)
    found = []
    for key in np.unique(keys):
        here = np.flatnonzero(keys == key)
        body = b"".join(held[t][f : f + n] for t, f, n in zip(runs.text[some[here]], runs.first[some[here]], rows["size"][here], strict=True))
        found.append(len(here).to_bytes(4, "little") + rows[here].tobytes() + body)
    return pd.DataFrame({"key": np.unique(keys), "kind": np.full(len(found), OPEN, dtype=np.int32), "data": found})


def refine(data: bytes, starts: np.ndarray, doc: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of the 50-byte strings at `starts` also start in a document with a smaller number than their `doc`.

    Bucket-pointer refinement: the bucket of a position is its rank among the 8-byte grams. A bucket of 2n bytes is the
    rank of (bucket, bucket n later). Strings alone in their bucket leave before the next sort.
    """
    bucket = _ranks(words(data))
    alive = starts
    for step in (8, 16, LENGTH - 32):
        # Every position a later step may look at is refined, so updates are reused.
        bucket = _refined(bucket, step)
        sizes = np.bincount(bucket[alive])
        alive = alive[sizes[bucket[alive]] > 1]
    order = np.argsort(starts, kind="stable")
    place = order[np.searchsorted(starts[order], alive)]
    gone = np.zeros(len(starts), dtype=bool)
    if len(alive):
        at = bucket[alive]
        least = np.full(at.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, at, doc[owner[place]])
        gone[place] = doc[owner[place]] > least[at]
    return gone


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _refined(bucket: np.ndarray, step: int) -> np.ndarray:
    """Ranks of (bucket, bucket `step` later); sorted are only positions that share their bucket."""
    n = len(bucket) - step
    if n <= 0:
        return bucket[:0]
    own = bucket[:n]
    sizes = np.bincount(own)
    shared = np.flatnonzero(sizes[own] > 1)
    pair = own[shared] * (int(bucket.max()) + 1) + bucket[shared + step]
    new = np.empty(n, dtype=np.int64)
    single = np.flatnonzero(sizes[own] == 1)
    ranks = _ranks(pair)
    new[shared] = ranks
    new[single] = np.arange(len(single)) + (ranks.max() + 1 if len(ranks) else 0)
    return new


def settle(fetched: DataFrame, blocks: int) -> DataFrame:
    """By block: the parts of runs that go (SOME)."""

    def group(part: pd.DataFrame) -> pd.DataFrame:
        heads, bodies = [], []
        for data in part["data"]:
            n = int.from_bytes(data[:4], "little")
            heads.append(np.frombuffer(data, dtype=PIECE, count=n, offset=4))
            bodies.append(data[4 + n * PIECE.itemsize :])
        rows, data = np.concatenate(heads), b"".join(bodies)
        sizes = rows["size"].astype(np.int64)
        begins, strings = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(rows)), strings)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
        gone = refine(data, begins[owner] + inner, rows["doc"], owner)
        # Runs of removed strings: edges where the flag or the piece changes.
        flag = np.flatnonzero(gone)
        cut = np.ones(len(flag), dtype=bool)
        cut[1:] = (np.diff(flag) > 1) | (owner[flag[1:]] != owner[flag[:-1]])
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(flag)) - 1
        out = np.empty(len(a), dtype=CUT)
        if len(a):
            out["uid"], out["run"] = rows["uid"][owner[flag[a]]], rows["run"][owner[flag[a]]]
            out["first"], out["last"] = inner[flag[a]], inner[flag[b]]
        return packed(_block(out["uid"].copy(), blocks), SOME, out)

    return fetched.groupBy("key").applyInPandas(group, _PACKED)


def spans(text: bytes, uid: int, whole: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the removed bytes of one text."""
    edges = np.zeros(len(text) + 1, dtype=np.int32)
    mine = np.array([uid], dtype=np.int64)
    for at, part in parts(text):
        runs = Runs([part])
        if not len(runs.text):
            continue
        uids = np.repeat(mine, len(runs.run))
        full = _member(uids, runs.run, whole)
        np.add.at(edges, at + runs.first[full], 1)
        np.add.at(edges, at + runs.first[full] + runs.count[full] + LENGTH - 1, -1)
        order = np.argsort(runs.run, kind="stable")
        low, high = (np.searchsorted(runs.run[order], some["run"], side=s) for s in ("left", "right"))
        for cut, i, j in zip(some, low, high, strict=True):
            for k in order[i:j]:
                edges[at + runs.first[k] + int(cut["first"])] += 1
                edges[at + runs.first[k] + int(cut["last"]) + LENGTH] -= 1
    marks = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]])))
    return marks[::2], marks[1::2]


def _block_column(blocks: int):
    # The same number as _block: the uid as an unsigned long, modulo blocks.
    return F.pmod(F.pmod(F.col("uid"), F.lit(blocks)) + F.when(F.col("uid") < 0, (1 << 64) % blocks).otherwise(0), F.lit(blocks)).cast("long")


def deduplicate(docs: DataFrame, columns: list[str] | None = None, digest: bool = False) -> DataFrame:
    """One row per document: `row` (a struct of `columns`, by default doc_id), n_bytes, n_removed, spans and kept.

    `kept` holds the bytes that remain (`digest`: their SHA-256 in hex), `spans` the removed runs as (first, end).
    """
    base = docs.select(
        row_of(columns or ["doc_id"]), "doc_id", F.xxhash64("doc_id", text_or_empty()).alias("uid"),
        text_or_empty().cast("binary").alias("data"),
    )
    size = base.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    ranges, blocks = max(1, -(-size // RANGE)), max(1, -(-size // BLOCK))
    decided = stored(decide(entries(base, ranges, blocks), ranges, blocks), "decided")
    cuts = stored(settle(stored(fetch(decided, base, ranges, blocks), "pieces"), blocks), "cuts")

    texts = base.select(_block_column(blocks).alias("key"), F.lit(TEXT).alias("kind"), "data", "uid", "doc_id", "row")
    marks = decided.where(F.col("kind") == WHOLE).unionByName(cuts)
    for field in texts.schema.fields[3:]:
        marks = marks.withColumn(field.name, F.lit(None).cast(field.dataType))
    shape = StructType().add("row", base.schema["row"].dataType).add("n_bytes", "long").add("n_removed", "long")
    shape = shape.add("spans", ArrayType(StructType().add("first", "long").add("end", "long"))).add("kept", "string" if digest else "binary")

    def group(table):
        import pyarrow as pa

        kind = table.column("kind").to_numpy()
        data = table.column("data")
        whole = np.frombuffer(b"".join(data.filter(pa.array(kind == WHOLE)).to_pylist()), dtype=NAME)
        some = np.frombuffer(b"".join(data.filter(pa.array(kind == SOME)).to_pylist()), dtype=CUT)
        whole, some = whole[np.argsort(whole["uid"], kind="stable")], some[np.argsort(some["uid"], kind="stable")]
        own = table.filter(pa.array(kind == TEXT))
        n_bytes, n_removed, runs, kept = [], [], [], []
        for text, uid, doc in zip(own.column("data").to_pylist(), own.column("uid").to_pylist(), own.column("doc_id").to_pylist(), strict=True):
            a, b = np.searchsorted(whole["uid"], [uid, uid + 1]) if uid < np.iinfo(np.int64).max else (0, len(whole))
            c, d = np.searchsorted(some["uid"], [uid, uid + 1]) if uid < np.iinfo(np.int64).max else (0, len(some))
            begins = ends = np.empty(0, np.int64)
            if doc is not None and (a < b or c < d):
                begins, ends = spans(text, uid, whole[a:b], some[c:d])
            n_bytes.append(len(text))
            n_removed.append(int((ends - begins).sum()))
            runs.append([{"first": int(x), "end": int(y)} for x, y in zip(begins, ends, strict=True)])
            left = b"".join(text[x:y] for x, y in zip([0, *ends], [*begins, len(text)], strict=True))
            kept.append(hashlib.sha256(left).hexdigest() if digest else left)
        pair = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        made = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(runs, pair), pa.array(kept, pa.string() if digest else pa.binary())]
        return pa.Table.from_arrays([own.column("row"), *made], names=["row", "n_bytes", "n_removed", "spans", "kept"])

    return texts.unionByName(marks.select(texts.columns)).groupBy("key").applyInArrow(group, shape)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = deduplicate(docs, digest=True)
    return found.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT md5(s) AS k, min(doc_id) AS least FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i FROM w JOIN m ON md5(s) = k WHERE doc_id > least),
e AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM g),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM e),
s AS (SELECT doc_id, nth, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY ALL),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM s),
k AS (
  SELECT d.doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
         string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
