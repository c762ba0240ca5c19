"""Token ids as length-delimited binary records with masked checksums, and a separate index of offsets.

A shard is one file per range of doc_id. Each record is

    length  uint64   checksum of the length  uint32   payload   checksum of the payload  uint32

all little-endian; a payload is a flag byte (1: has a doc_id), a byte with the width of an id, the doc_id as int64 and
the ids. Checksums are CRC-32, rotated right by 15 bits plus a constant, so that a checksum of data which holds
checksums stays useful. Beside each shard lies an index with the offset of each record as uint64; a shuffled read
draws records by it. A manifest (Parquet) lists the shards in order with the number of ids before each.

A task writes its shard under a name of its own and returns that name; only names in the manifest count, so retried,
lost or speculative attempts leave nothing that is read.

Defined results: a null or empty text is only the end id. Null doc_ids come first. Rows that share a doc_id are
records of their own, ordered by a hash of their text. An empty table gives no shard and an empty result. Only
`doc_id` and `text` are read. A record that does not match its checksums raises.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, text_or_empty
from .subwords import MEMO, encoder

END_ID = 2
# Fixed value: added to a rotated checksum.
MASK_DELTA = 0xA282EAD8
HEAD, PAYLOAD_HEAD, TAIL = "<QI", "<BBq", "<I"  # layouts of struct
BATCH = 256
_SHARDS = "part int, shard string, records long, ids long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked(length).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(stream) -> Iterator[bytes]:
    """Payloads of a stream of records."""
    while head := stream.read(struct.calcsize(HEAD)):
        if len(head) < struct.calcsize(HEAD) or masked(head[:8]) != struct.unpack(HEAD, head)[1]:
            raise ValueError("damaged record length")
        length = struct.unpack(HEAD, head)[0]
        payload, tail = stream.read(length), stream.read(struct.calcsize(TAIL))
        if len(payload) < length or len(tail) < struct.calcsize(TAIL) or masked(payload) != struct.unpack(TAIL, tail)[0]:
            raise ValueError("damaged record")
        yield payload


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, memo: int = MEMO) -> DataFrame:
    """Write `docs` in ascending doc_id order to `folder`; returns the manifest. `memo` trades a worker's memory for time.

    Rows are range-partitioned by doc_id and a hash of the text, so not even a repeated doc_id makes a partition large.
    A task holds one batch of rows at a time.
    """
    rows = (
        docs.select("doc_id", text_or_empty().alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        files, root = _files(folder)
        name, out, at, ids, offsets, coder = f"shard-{uuid.uuid4().hex}", None, 0, 0, [], encoder(vocabulary, memo)
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        for batch in batches:
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}.bin")
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                packed = coder.batch(part.column("text").to_pylist())
                for doc, data in zip(part.column("doc_id").to_pylist(), packed, strict=True):
                    known = doc is not None
                    record = frame(struct.pack(PAYLOAD_HEAD, known, coder.dtype.itemsize, doc if known else 0) + data + end)
                    offsets.append(at)
                    at += len(record)
                    ids += len(data) // coder.dtype.itemsize + 1
                    out.write(record)
        if out is not None:
            out.close()
            with files.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(np.array(offsets, dtype="<u8").tobytes())
            made = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([len(offsets)]), pa.array([ids])]
            yield pa.RecordBatch.from_arrays(made, names=["part", "shard", "records", "ids"])

    # One row per shard: the window runs over that list only.
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shards = rows.mapInArrow(task, _SHARDS)
    spark = docs.sparkSession
    shards.write.parquet(f"{folder}/shards")
    shards = spark.read.schema(_SHARDS).parquet(f"{folder}/shards")
    shards.withColumn("start", F.coalesce(before, F.lit(0))).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_SHARDS + ", start long").parquet(f"{folder}/manifest")


def _decode(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, width, doc = struct.unpack_from(PAYLOAD_HEAD, payload)
    return doc if known else None, np.frombuffer(payload, dtype=f"<u{width}", offset=struct.calcsize(PAYLOAD_HEAD))


_COLUMNS = {"doc_id": "long", "start": "long", "n_tokens": "long", "ids": "array<int>", "ids_crc32": "long"}


def _table(rows: list[tuple[int | None, int, np.ndarray]], columns: list[str]) -> pd.DataFrame:
    make = {
        "doc_id": lambda: pd.array([r[0] for r in rows], dtype="Int64"),
        "start": lambda: [r[1] for r in rows],
        "n_tokens": lambda: [len(r[2]) for r in rows],
        "ids": lambda: [r[2].astype(np.int32) for r in rows],
        "ids_crc32": lambda: [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows],
    }
    return pd.DataFrame({c: make[c]() for c in columns})


def read(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The records of all shards in manifest order, one task per shard; `columns` of doc_id, start, n_tokens, ids, ids_crc32."""
    shards, columns = manifest(spark, folder), list(columns)

    def task(batches):
        files, root = _files(folder)
        for batch in batches:
            for name, at in zip(batch["shard"], batch["start"], strict=True):
                with files.open_input_stream(f"{root}/{name}.bin", buffer_size=1 << 20) as stream:
                    rows = []
                    for payload in unframe(stream):
                        doc, ids = _decode(payload)
                        rows.append((doc, at, ids))
                        at += len(ids)
                        if len(rows) == BATCH:
                            yield _table(rows, columns)
                            rows = []
                    if rows:
                        yield _table(rows, columns)

    count = max(1, shards.count())
    return shards.repartitionByRange(count, "part").mapInPandas(task, ", ".join(f"{c} {_COLUMNS[c]}" for c in columns))


def shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """All records in an order drawn from `seed`: (turn, doc_id, n_tokens, ids), each row sought by its offset."""
    shards = manifest(spark, folder).select("shard")

    def offsets(batches):
        files, root = _files(folder)
        for batch in batches:
            for name in batch["shard"]:
                with files.open_input_stream(f"{root}/{name}.idx") as stream:
                    while data := stream.read(8 << 15):
                        yield pd.DataFrame({"shard": name, "at": np.frombuffer(data, dtype="<u8").astype(np.int64)})

    def task(batches):
        files, root = _files(folder)
        for batch in batches:
            rows, held, stream = [], None, None
            for turn, name, at in zip(batch["turn"], batch["shard"], batch["at"], strict=True):
                if name != held:
                    held, stream = name, files.open_input_file(f"{root}/{name}.bin")
                stream.seek(at)
                doc, ids = _decode(next(unframe(stream)))
                rows.append((turn, doc, ids))
            table = _table([(d, 0, ids) for _, d, ids in rows], ["doc_id", "n_tokens", "ids"])
            yield table.assign(turn=[r[0] for r in rows])[["turn", "doc_id", "n_tokens", "ids"]]

    turn = F.xxhash64(F.lit(seed), "shard", "at")
    places = shards.mapInPandas(offsets, "shard string, at long").withColumn("turn", turn)
    ordered = places.repartitionByRange("turn", "shard", "at").sortWithinPartitions("turn", "shard", "at")
    return ordered.mapInPandas(task, "turn long, doc_id long, n_tokens long, ids array<int>")


def encode(docs: DataFrame, vocabulary: str, end_id: int = END_ID, memo: int = MEMO) -> DataFrame:
    """Write `docs` to a new shared folder and return the digest rows read back from the files."""
    spark = docs.sparkSession
    folder = new_folder(spark, "records")
    write(docs, folder, vocabulary, end_id, memo)
    return read(spark, folder, ("doc_id", "start", "n_tokens", "ids_crc32"))


def op3_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
