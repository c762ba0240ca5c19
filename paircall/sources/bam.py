"""BAM, as a Python data source named `bam`.

The `.bai` index gives virtual offsets at which records begin. They cut a file into partitions of
similar compressed size, which are read independently and arrive as Arrow batches. An index is
required. The option `regions` selects partitions through it.

`read_bam` plans by a Spark job over the files: tasks read headers and indexes, the driver gets the splits and the
contig dictionaries only. Loaded directly, the source plans on the driver, file after file.

The source takes no filters from Spark: in Spark 4.1 the filters that one query pushes into a Python source
stay with the loaded table, and a second query on the same DataFrame would miss rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.ranges import in_regions
from ..operators.reads import in_region
from ..schema import ALIGNMENT, BASE_CODES
from .files import exists, list_files, open_input, read_all

# ---- fixed values of the file format ------------------------------------------------------------
BAM_MAGIC = b"BAM\x01"
BAI_MAGIC = b"BAI\x01"
METADATA_BIN = 37450
FIRST_LEAF_BIN = 4681
LINEAR_SHIFT = 14
CIGAR_OPS = "MIDNSHP=X"
TAG_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "d": "d"}
# -------------------------------------------------------------------------------------------------

SPLIT_BYTES = 32 << 20
MIN_PART_BYTES = 512
BATCH_ROWS = 8192
BATCH_BYTES = 32 << 20  # of records that are decoded at once, whatever their number
NO_END = 1 << 40  # past any position


@dataclass
class Header:
    text: str
    names: list[str]
    lengths: list[int]


@dataclass
class BamSplit(InputPartition):
    """Records from `begin` up to `end`; None is the end of the file.

    Both are virtual offsets from the index, or negative: then the split is a part of a stretch too long for
    one task, and the border is the first record in a block that starts at byte -value or later. `limit` is
    the virtual offset at which the stretch ends.
    """

    path: str
    begin: int
    end: int | None
    limit: int | None = None

    def __init__(self, path: str, begin: int, end: int | None, limit: int | None = None):
        self.path, self.begin, self.end, self.limit = path, begin, end, limit


class BlockStream:
    """Decompressed bytes from a virtual offset on, with the virtual offset of any byte still held."""

    def __init__(self, f, voffset: int):
        self.f, self.next_block = f, voffset >> 16
        self.buffer, self.position = bytearray(), 0
        self.starts, self.blocks = [], []  # buffer index and file offset of each held block
        self.f.seek(self.next_block)
        self._fill(1)
        self.position = voffset & 0xFFFF

    def _fill(self, size: int) -> bool:
        while len(self.buffer) - self.position < size:
            self.f.seek(self.next_block)
            head = self.f.read(18)
            if len(head) < 18:
                return False
            if head[:4] != b"\x1f\x8b\x08\x04":
                raise ValueError(f"no compressed block at byte {self.next_block}")
            extra = struct.unpack_from("<H", head, 10)[0]
            rest = head[12:] + self.f.read(max(0, extra - 6))
            length, i = None, 0
            while i + 4 <= extra:
                size_of = struct.unpack_from("<H", rest, i + 2)[0]
                if rest[i:i + 2] == b"BC":
                    length = struct.unpack_from("<H", rest, i + 4)[0] + 1
                i += 4 + size_of
            if length is None:
                raise ValueError(f"compressed block at byte {self.next_block} has no size")
            body = self.f.read(length - 12 - extra)
            self.starts.append(len(self.buffer))
            self.blocks.append(self.next_block)
            self.buffer += zlib.decompress(body[:-8], -15)
            self.next_block += length
        return True

    def available(self, size: int) -> bool:
        """Hold `size` bytes; True if the file ends before that."""
        return not self._fill(size)

    def voffset(self) -> int:
        """Virtual offset of the next byte; at the end of a block that of the next block."""
        i = bisect_right(self.starts, self.position) - 1
        end = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.buffer)
        if self.position == end:
            return (self.blocks[i + 1] if i + 1 < len(self.blocks) else self.next_block) << 16
        return self.blocks[i] << 16 | (self.position - self.starts[i])

    def take(self, size: int) -> bytes | None:
        """The next `size` bytes, or None at the end of the file."""
        if not self._fill(size):
            if len(self.buffer) == self.position:
                return None
            raise EOFError("truncated file")
        out = bytes(self.buffer[self.position:self.position + size])
        self.position += size
        return out

    def release(self) -> None:
        """Drop the blocks before the current position."""
        i = bisect_right(self.starts, self.position) - 1
        if i > 0:
            cut = self.starts[i]
            del self.buffer[:cut]
            self.position -= cut
            self.starts = [s - cut for s in self.starts[i:]]
            self.blocks = self.blocks[i:]


def read_bam_header(path: str) -> tuple[Header, int]:
    """The header and the virtual offset of the first record."""
    with open_input(path) as f:
        stream = BlockStream(f, 0)
        number = lambda: struct.unpack("<i", stream.take(4))[0]
        if stream.take(4) != BAM_MAGIC:
            raise ValueError(f"{path} is not a BAM file")
        text = stream.take(number()).rstrip(b"\x00").decode()
        names, lengths = [], []
        for _ in range(number()):
            names.append(stream.take(number())[:-1].decode())
            lengths.append(number())
        return Header(text, names, lengths), stream.voffset()


@dataclass
class ContigIndex:
    begin: int | None  # first and last virtual offset of the contig's records
    end: int | None
    linear: list[int]  # first record that reaches each 16 kb window, 0 if none
    leaves: dict[int, int]  # first record that lies within each 16 kb window
    mapped: int = 0
    unmapped: int = 0

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last virtual offset that may hold reads of each region [start, end), by searching sorted windows."""
        linear = np.array(self.linear, dtype=np.int64)
        reached = np.flatnonzero(linear)
        begin = np.full(len(starts), self.begin, dtype=np.int64)
        if len(linear):
            # The first record that reaches the window of `start`, or any later window if that one is empty.
            after = np.append(linear[reached], self.end)[np.searchsorted(reached, starts >> LINEAR_SHIFT)]
            begin = np.where(starts > 0, np.maximum(begin, after), begin)
        # Records are in order, so those behind one that lies in a window past the bound start past it too.
        windows = np.array(sorted(self.leaves), dtype=np.int64)
        lows = np.array([self.leaves[w] for w in windows.tolist()] + [self.end], dtype=np.int64)
        least = np.minimum.accumulate(lows[::-1])[::-1]
        return begin, least[np.searchsorted(windows, -(-np.maximum(ends, 0) >> LINEAR_SHIFT))]


def index_path(path: str) -> str:
    for candidate in (path + ".bai", path[:-1] + "i" if path.endswith(".bam") else path + ".bai"):
        if exists(candidate):
            return candidate
    raise FileNotFoundError(f"{path} has no .bai index")


def read_index(path: str) -> tuple[list[ContigIndex], list[int]]:
    """Per-contig index entries, and all virtual offsets at which the index says a record begins."""
    data, at = read_all(path), 8
    if data[:4] != BAI_MAGIC:
        raise ValueError(f"{path} is not a BAM index")
    contigs, offsets = [], set()
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        entry = ContigIndex(None, None, [], {})
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", data, at)
            pairs = np.frombuffer(data, "<u8", 2 * chunks, at + 8).reshape(-1, 2)
            at += 8 + 16 * chunks
            if number == METADATA_BIN:
                entry.mapped, entry.unmapped = (int(x) for x in pairs[1])
                continue
            offsets.update(pairs[:, 0].tolist())
            low, high = int(pairs[:, 0].min()), int(pairs[:, 1].max())
            entry.begin = low if entry.begin is None else min(entry.begin, low)
            entry.end = high if entry.end is None else max(entry.end, high)
            if number >= FIRST_LEAF_BIN:
                entry.leaves[number - FIRST_LEAF_BIN] = low
        windows = struct.unpack_from("<i", data, at)[0]
        entry.linear = np.frombuffer(data, "<u8", windows, at + 4).tolist()
        at += 4 + 8 * windows
        offsets.update(v for v in entry.linear if v)
        contigs.append(entry)
    return contigs, sorted(offsets)


def wanted_ranges(header: Header, entries: list[ContigIndex], regions) -> list[tuple[int, int]] | None:
    """Disjoint ranges of virtual offsets that may hold reads of the regions; None for the whole file.

    Contigs that the file does not have hold nothing.
    """
    by_contig: dict[str, list[tuple[int, int]]] = {}
    for chrom, start, until in regions:
        by_contig.setdefault(chrom, []).append((start, NO_END if until is None else until))
    if "*" in by_contig:
        return None
    found = [(np.empty(0, np.int64),) * 2]
    for chrom, entry in zip(header.names, entries):
        if chrom in by_contig and entry.begin is not None:
            found.append(entry.ranges(*np.array(by_contig[chrom], dtype=np.int64).T))
    begin, end = (np.concatenate(side) for side in zip(*found))
    order = np.argsort(begin, kind="stable")
    order = order[begin[order] < end[order]]
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    opens = np.flatnonzero(np.append(True, begin[1:] > reach[:-1])[: len(begin)])
    return list(zip(begin[opens].tolist(), reach[np.append(opens[1:], len(begin)) - 1].tolist())) if len(begin) else []


def plan_splits(path: str, size: int, split_bytes: int, regions: list[tuple[str, int, int | None]] | None, header: Header | None = None, first: int = 0) -> list[BamSplit]:
    """Splits of a file of about `split_bytes` of compressed data. Header and index are read once.

    Ranges and cuts are both sorted, so each range begins its walk at the cut before it.
    """
    if header is None:
        header, first = read_bam_header(path)
    entries, offsets = read_index(index_path(path))
    ranges = None if regions is None else wanted_ranges(header, entries, regions)
    cuts, splits = [first], []
    for offset in offsets:
        if offset > first and (offset >> 16) - (cuts[-1] >> 16) >= split_bytes:
            cuts.append(offset)
    if ranges is None:
        return [part for low, high in zip(cuts, [*cuts[1:], None]) for part in _parts(path, low, high, size, split_bytes)]
    for begin, end in ranges:
        low, at = max(begin, first), bisect_right(cuts, begin)
        while low < end:
            high = min(end, cuts[at]) if at < len(cuts) else end
            splits += _parts(path, low, high, size, split_bytes)
            low, at = high, at + 1
    return splits


def _parts(path: str, low: int, high: int | None, size: int, split_bytes: int) -> list[BamSplit]:
    """One split, or several where the index knows no record inside a long stretch, as at a very deep position."""
    last, step = size if high is None else high >> 16, max(split_bytes, MIN_PART_BYTES)
    borders = [-at for at in range((low >> 16) + step, last - step // 2, step)]
    ends = [*borders, high]
    return [BamSplit(path, begin, end, high) for begin, end in zip([low, *borders], ends)]


_CHAIN = 4  # sound records in a row that make a border
_WINDOW = 1 << 18


def _record_size(data: bytes, at: int, header: Header) -> int:
    """Length of the record at `at` with its length field, 0 if `data` ends inside it, -1 if it is none."""
    if at + 36 > len(data):
        return 0
    size, tid, pos, name_len, _, _, cigars, _, seq_len, mate_tid, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    contigs = len(header.names)
    sound = (
        name_len > 0
        and seq_len >= 0
        and -1 <= tid < contigs
        and -1 <= mate_tid < contigs
        and -1 <= pos <= (header.lengths[tid] if tid >= 0 else 1 << 31)
        and -1 <= mate_pos <= (header.lengths[mate_tid] if mate_tid >= 0 else 1 << 31)
        and size >= 32 + name_len + 4 * cigars + (seq_len + 1) // 2 + seq_len
    )
    if not sound:
        return -1
    names_end = at + 36 + name_len
    if names_end + 4 * cigars > len(data):
        return 0
    if data[names_end - 1] != 0 or not all(33 <= c <= 126 for c in data[at + 36:names_end - 1]):
        return -1
    if any(data[names_end + 4 * i] & 15 > 8 for i in range(cigars)):
        return -1
    return 4 + size


def find_record(f, byte: int, header: Header, limit: int | None) -> int | None:
    """Virtual offset of the first record in a block at `byte` or later; `limit` if there is none before it.

    A block is recognised by its header and by another block behind it, a record by a chain of sound records.
    A wrong border cannot pass unnoticed: the split before it has to end exactly there.
    """
    for block in _block_starts(f, byte):
        if limit is not None and block << 16 >= limit:
            return limit
        stream, want = BlockStream(f, block << 16), _WINDOW
        complete = stream.available(want)
        at = 0
        while at < len(stream.buffer):
            position, length, found = at, 0, 0
            while found < _CHAIN:
                length = _record_size(stream.buffer, position, header)
                if length == 0 and not complete:
                    want *= 2
                    complete = stream.available(want)
                    continue
                if length <= 0:
                    break
                position, found = position + length, found + 1
                if position > len(stream.buffer) and not complete:
                    complete = stream.available(max(want, position + 36))
            if found == _CHAIN or (found > 0 and complete and position == len(stream.buffer)):
                stream.position = at
                result = stream.voffset()
                return result if limit is None else min(result, limit)
            at += 1
    return limit


def _block_starts(f, byte: int) -> Iterator[int]:
    """Bytes at `byte` or later at which a compressed block starts and another one, or nothing, follows it."""
    size, at = f.size(), byte
    while at < size:
        f.seek(at)
        data = f.read(1 << 17)
        i = data.find(b"\x1f\x8b\x08\x04")
        while i >= 0 and i + 18 <= len(data):
            if data[i + 10:i + 16] == b"\x06\x00BC\x02\x00":
                after = at + i + struct.unpack_from("<H", data, i + 16)[0] + 1
                f.seek(after)
                if after == size or f.read(4) == b"\x1f\x8b\x08\x04":
                    yield at + i
            i = data.find(b"\x1f\x8b\x08\x04", i + 1)
        at += max(len(data) - 17, 1)


def _ragged(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many slices of `data`, one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return data[np.arange(total) + shift]


def _strings(data: np.ndarray, lengths: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
    """Arrow strings from consecutive bytes; rows that are not `present` are null."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    mask = None if present is None else pa.py_buffer(np.packbits(present, bitorder="little").tobytes())
    buffers = [mask, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.string(), len(lengths), buffers)


_PAIRS = np.array([[ord(BASE_CODES[b >> 4]), ord(BASE_CODES[b & 15])] for b in range(256)], dtype=np.uint8)


_OP_LETTERS = np.frombuffer(CIGAR_OPS.encode(), np.uint8)


def _cigars(data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.Array:
    """CIGAR strings of all records: digits of every operation's length, its letter; `*` where there is none."""
    packed = _ragged(data, starts, 4 * counts).view("<u4").astype(np.int64)
    lengths, letters = packed >> 4, _OP_LETTERS[np.minimum(packed & 15, len(CIGAR_OPS) - 1)]
    digits = np.searchsorted(10 ** np.arange(1, 10), lengths, side="right") + 1
    ends = np.cumsum(digits + 1)
    text = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    text[ends - 1] = letters
    for place in range(int(digits.max(initial=0))):
        some = np.flatnonzero(digits > place)
        text[ends[some] - 2 - place] = 48 + lengths[some] // 10**place % 10
    before = np.concatenate(([0], ends))
    first = np.concatenate(([0], np.cumsum(counts)))
    sizes = before[first[1:]] - before[first[:-1]]
    none = np.flatnonzero(counts == 0)
    # An operation-less record says `*`: one byte is put in before the text of the records that follow.
    return _strings(np.insert(text, before[first[none]], 42), np.where(counts == 0, 1, sizes))


def _number(value: float, kind: str) -> str:
    """Shortest text that reads back to the same float."""
    text = str(np.float32(value)) if kind == "f" else repr(float(value))
    return text.removesuffix(".0")


def _tags(record: bytes, at: int) -> list[tuple[str, str]]:
    """Tags as (key, `TYPE:VALUE`); of a repeated key the first."""
    out: dict[str, str] = {}
    while at + 3 <= len(record):
        key, kind = record[at:at + 2].decode("latin-1"), chr(record[at + 2])
        at += 3
        if kind == "A":
            value, at = f"A:{chr(record[at])}", at + 1
        elif kind in "ZH":
            end = record.index(b"\x00", at)
            value, at = f"{kind}:{record[at:end].decode('utf-8', 'replace')}", end + 1
        elif kind == "B":
            code, count = chr(record[at]), struct.unpack_from("<i", record, at + 1)[0]
            layout = f"<{count}{TAG_NUMBERS[code]}"
            numbers = struct.unpack_from(layout, record, at + 5)
            value, at = "B:" + ",".join([code, *(_number(x, code) if code == "f" else str(x) for x in numbers)]), at + 5 + struct.calcsize(layout)
        elif kind in TAG_NUMBERS:
            layout = "<" + TAG_NUMBERS[kind]
            number, at = struct.unpack_from(layout, record, at)[0], at + struct.calcsize(layout)
            value = f"{kind}:{_number(number, kind)}" if kind in "fd" else f"i:{number}"
        else:
            raise ValueError(f"unknown tag type {kind!r}")
        out.setdefault(key, value)
    return list(out.items())


_CORE = np.dtype([
    ("tid", "<i4"), ("pos", "<i4"), ("name_len", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("cigar_len", "<u2"), ("flag", "<u2"),
    ("seq_len", "<i4"), ("mate_tid", "<i4"), ("mate_pos", "<i4"), ("isize", "<i4"),
])


def _batch(records: list[bytes], names: np.ndarray, sample: str, with_tags: bool) -> pa.RecordBatch:
    """Arrow batch of raw records; fixed fields, names, bases and qualities are cut out with numpy."""
    n = len(records)
    sizes = np.array([len(r) for r in records], dtype=np.int64)
    data = np.frombuffer(b"".join(records), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    core = np.frombuffer(_ragged(data, starts, np.full(n, _CORE.itemsize)).tobytes(), dtype=_CORE)
    name_len, seq_len = core["name_len"].astype(np.int64), core["seq_len"].astype(np.int64)
    cigar_at = _CORE.itemsize + name_len
    seq_at = cigar_at + 4 * core["cigar_len"].astype(np.int64)
    qual_at = seq_at + (seq_len + 1) // 2
    contig = lambda tid: pa.array(names[np.where((tid >= 0) & (tid < len(names) - 1), tid, len(names) - 1)], pa.string())

    packed = _ragged(data, starts + seq_at, (seq_len + 1) // 2)
    letters = _PAIRS[packed].reshape(-1)
    letters = _ragged(letters, 2 * np.concatenate(([0], np.cumsum((seq_len + 1) // 2)[:-1])), seq_len)
    has_seq = seq_len > 0
    first_quality = np.where(has_seq, data[np.minimum(starts + qual_at, len(data) - 1)], 0xFF)
    has_quality = first_quality != 0xFF
    qualities = _ragged(data, starts + qual_at, np.where(has_quality, seq_len, 0)) + np.uint8(33)

    columns = {
        "sample": pa.array([sample] * n, pa.string()),
        "qname": _strings(_ragged(data, starts + _CORE.itemsize, name_len - 1), name_len - 1),
        "flag": pa.array(core["flag"].astype(np.int32)),
        "chrom": contig(core["tid"]),
        "pos": pa.array(core["pos"].astype(np.int32)),
        "mapq": pa.array(core["mapq"].astype(np.int32)),
        "cigar": _cigars(data, starts + cigar_at, core["cigar_len"].astype(np.int64)),
        "mate_chrom": contig(core["mate_tid"]),
        "mate_pos": pa.array(core["mate_pos"].astype(np.int32)),
        "isize": pa.array(core["isize"].astype(np.int32)),
        "seq": _strings(letters, seq_len, has_seq),
        "qual": _strings(qualities, np.where(has_quality, seq_len, 0), has_quality),
        "tags": pa.array(
            [_tags(r, int(a)) for r, a in zip(records, qual_at + seq_len)] if with_tags else [None] * n,
            pa.map_(pa.string(), pa.string()),
        ),
    }
    return pa.RecordBatch.from_pydict(columns)


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.sample = options.get("sample", "")
        self.with_tags = options.get("tags", "true").lower() == "true"
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        # Wanted regions: contig, lower bound of the end position, exclusive upper bound of the start position.
        self.regions = [tuple(r) for r in json.loads(options["regions"])] if "regions" in options else None
        self.splits = json.loads(options["splits"]) if "splits" in options else None

    def partitions(self):
        if self.splits is not None:
            return [BamSplit(path, *border) for path, borders in self.splits for border in borders]
        return [split for file in list_files(self.path, (".bam",)) for split in plan_splits(*file, self.split_bytes, self.regions)]

    def read(self, partition: BamSplit | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read: no partition was planned
            return
        header, _ = read_bam_header(partition.path)
        names = np.array([*header.names, "*"], dtype=object)
        with open_input(partition.path) as f:
            begin, end, searched = partition.begin, partition.end, None
            if begin < 0:
                begin = find_record(f, -begin, header, partition.limit)
            if end is not None and end < 0:
                end = find_record(f, -end, header, partition.limit)
                searched = end if end != partition.limit else None
            if begin is None or begin == end:
                return
            stream = BlockStream(f, begin)
            records: list[bytes] = []
            held = 0
            while end is None or stream.voffset() < end:
                size = stream.take(4)
                if size is None:
                    break
                records.append(stream.take(struct.unpack("<i", size)[0]))
                held += len(records[-1])
                if len(records) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield _batch(records, names, self.sample, self.with_tags)
                    records, held = [], 0
                    stream.release()
            if searched is not None and stream.voffset() != searched:
                raise ValueError(f"{partition.path}: no record begins at virtual offset {end}; use a larger splitBytes")
            if records:
                yield _batch(records, names, self.sample, self.with_tags)


class BamSource(DataSource):
    """Options: `path` (file or directory), `sample`, `tags` (true|false), `splitBytes`, `regions` (JSON list of contig, start, end or null).

    `splits` (JSON list of path and borders) holds a finished plan, in place of `regions`.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self):
        return ALIGNMENT

    def reader(self, schema) -> BamReader:
        return BamReader({k.lower(): v for k, v in self.options.items()})


def register_bam(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def read_bam(
    spark: SparkSession,
    path: str,
    sample: str,
    region: tuple[str, int, int | None] | None = None,
    tags: bool = True,
    split_bytes: int = SPLIT_BYTES,
    regions: list[tuple[str, int, int | None]] | None = None,
    whole: bool = False,
) -> DataFrame:
    """Alignment rows of indexed BAM files. Tags cost time per read; `tags=False` leaves them null.

    With a region `(chrom, start, end)`, or several, only the parts of the files that the index names are read, and
    the reads that overlap a region come back whole, each once; `whole` leaves in what else those parts hold, for
    callers that filter later. A contig that no file has is an error.
    """
    register_bam(spark)
    wanted = [region] if region is not None else regions
    lengths, splits = _planned(spark, path, split_bytes, wanted)
    for chrom, _, _ in wanted or []:
        if chrom != "*" and chrom not in lengths:
            raise ValueError(f"unknown contig: {chrom} is not in {path}")
    reader = spark.read.format("bam").option("sample", sample).option("tags", str(tags).lower())
    reads = reader.option("splits", json.dumps(splits)).load(path)
    if wanted is None or whole:
        return reads
    if region is not None:
        return in_region(reads, *region)
    table = spark.createDataFrame([(c, s, lengths.get(c, s) if e is None else e) for c, s, e in wanted], "chrom string, start int, end int")
    return in_regions(reads, table)


def _on_files(spark: SparkSession, path: str, per_file, schema: str) -> DataFrame:
    """The rows that `per_file(path, size)` gives for every file of a path, made in tasks."""
    files = list_files(path, (".bam",))
    table = spark.createDataFrame(files, "path string, size long").repartition(max(1, len(files)), "path")

    def task(batches):
        for batch in batches:
            for file, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                yield per_file(file, size)

    return table.mapInArrow(task, schema)


def _planned(spark: SparkSession, path: str, split_bytes: int, regions) -> tuple[dict[str, int], list]:
    """Lengths of the contigs that any file has, and the splits of all files as (path, borders)."""

    def per_file(file: str, size: int) -> pa.RecordBatch:
        header, first = read_bam_header(file)
        borders = [[s.begin, s.end, s.limit] for s in plan_splits(file, size, split_bytes, regions, header, first)]
        named = json.dumps(list(zip(header.names, header.lengths)))
        return pa.RecordBatch.from_pydict({"path": [file], "contigs": [named], "borders": [json.dumps(borders)]})

    planned = _on_files(spark, path, per_file, "path string, contigs string, borders string").persist()
    try:
        # Files of one sample mostly share a dictionary, so each one that differs comes to the driver once.
        dictionaries = [json.loads(r.contigs) for r in planned.select("contigs").distinct().collect()]
        splits = [(r.path, json.loads(r.borders)) for r in planned.select("path", "borders").orderBy("path").collect()]
    finally:
        planned.unpersist()
    return _one_dictionary(path, dictionaries), splits


def _one_dictionary(path: str, dictionaries: list) -> dict[str, int]:
    lengths: dict[str, int] = {}
    for chrom, length in (pair for each in dictionaries for pair in each):
        if lengths.setdefault(chrom, length) != length:
            raise ValueError(f"contig {chrom} has lengths {lengths[chrom]} and {length} in the files of {path}")
    return lengths


def read_bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contig dictionary `chrom, length, tid` of a BAM file, or of all files of a folder: headers are read in tasks.

    `tid` is the smallest of the files that have the contig. Lengths that differ between files are an error.
    """

    def per_file(file: str, size: int) -> pa.RecordBatch:
        header, _ = read_bam_header(file)
        return pa.RecordBatch.from_pydict({"chrom": pa.array(header.names, pa.string()), "length": pa.array(header.lengths, pa.int32()), "tid": pa.array(range(len(header.names)), pa.int32())})

    found = _on_files(spark, path, per_file, "chrom string, length int, tid int").groupBy("chrom")
    found = found.agg(F.min("length").alias("length"), F.max("length").alias("_most"), F.min("tid").alias("tid"))
    differ = F.raise_error(F.concat(F.lit("contig with several lengths: "), F.col("chrom"))).cast("int")
    return found.select("chrom", F.when(F.col("length") == F.col("_most"), F.col("length")).otherwise(differ).alias("length"), "tid").orderBy("tid", "chrom")


def read_bam_index_stats(spark: SparkSession, path: str) -> DataFrame:
    """`chrom, length, mapped, unmapped` as the indexes record them, added up over the files of a folder."""

    def per_file(file: str, size: int) -> pa.RecordBatch:
        header, _ = read_bam_header(file)
        entries, _ = read_index(index_path(file))
        rows = [(n, length, e.mapped, e.unmapped) for n, length, e in zip(header.names, header.lengths, entries)]
        columns = [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays(columns, names=["chrom", "length", "mapped", "unmapped"])

    found = _on_files(spark, path, per_file, "chrom string, length long, mapped long, unmapped long")
    return found.groupBy("chrom").agg(F.max("length").alias("length"), F.sum("mapped").alias("mapped"), F.sum("unmapped").alias("unmapped"))
