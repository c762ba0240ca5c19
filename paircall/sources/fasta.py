"""FASTA to a chunk table `chrom, chunk_id, chunk_start, seq, width`.

A file is cut into pieces of some megabytes, each with its byte range and the contig position it starts
at, and every piece is read by its own task. With a `.fai` index the pieces follow from arithmetic on
the index; without one a first pass over byte ranges finds the headers and counts the bases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CHUNK, CHUNK_TABLE
from .files import exists, list_files, open_input

PIECE_BYTES = 8 << 20
_BLANK = bytes(range(33)) + b"\x7f"


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """`name, length, offset, line_bases, line_bytes` of a FASTA index."""
    schema = "name string, length long, offset long, line_bases int, line_bytes int"
    return spark.read.option("sep", "\t").schema(schema).csv(path)


def _pieces_from_index(fai: DataFrame, path: str, piece_bytes: int, chunk: int) -> DataFrame:
    """Pieces that begin on a chunk border. `first` is the contig position, `start` the byte of its base."""
    step = max(chunk, piece_bytes // chunk * chunk)
    byte_of = lambda base: F.col("offset") + F.floor(base / F.col("line_bases")) * F.col("line_bytes") + base % F.col("line_bases")
    firsts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))
    return (
        fai.where("length > 0")
        .withColumn("first", F.explode(firsts))
        .withColumn("bases", F.least(F.lit(step).cast("long"), F.col("length") - F.col("first")))
        .select(F.lit(path).alias("file"), F.col("name").alias("chrom"), "first", "bases", byte_of(F.col("first")).alias("start"))
    )


def _scan_range(path: str, start: int, end: int) -> Iterator[tuple[int, str | None, int]]:
    """Runs of sequence in [start, end) as (byte, contig or None if it began earlier, bases).

    A header belongs to the range that holds its `>`, also where its line reaches over the end.
    """
    with open_input(path) as f:
        f.seek(max(start - 1, 0))
        at_line_start = start == 0 or f.read(1) == b"\n"
        data = f.read(end - start)
        if not at_line_start and _inside_header(f, start):
            cut = data.find(b"\n") + 1
            if cut == 0:
                return
            start, data, at_line_start = start + cut, data[cut:], True
        at, name = 0, None
        for header in re.finditer(rb"(?:\A|(?<=\n))>([^\n]*)" if at_line_start else rb"(?<=\n)>([^\n]*)", data):
            yield start + at, name, _letters(data[at:header.start()])
            title = header[1] + (_rest_of_line(f, end) if header.end() == len(data) else b"")
            at, name = header.end(), (title.split() or [b""])[0].decode()
        yield start + at, name, _letters(data[at:])


def _letters(data: bytes) -> int:
    return len(data.translate(None, _BLANK))


def _rest_of_line(f, offset: int) -> bytes:
    f.seek(offset)
    out = b""
    while block := f.read(4096):
        cut = block.find(b"\n")
        if cut >= 0:
            return out + block[:cut]
        out += block
    return out


def _inside_header(f, offset: int) -> bool:
    """Whether the line that contains the byte at `offset` starts with `>`."""
    step, tail = 4096, offset
    while tail > 0:
        begin = max(0, tail - step)
        f.seek(begin)
        block = f.read(tail - begin)
        cut = block.rfind(b"\n")
        if cut >= 0:
            f.seek(begin + cut + 1)
            return f.read(1) == b">"
        tail = begin
    f.seek(0)
    return f.read(1) == b">"


def _pieces_by_scan(spark: SparkSession, path: str, piece_bytes: int) -> DataFrame:
    ranges = [
        (name, start, min(start + piece_bytes, size))
        for name, size in list_files(path)
        for start in range(0, size, piece_bytes)
    ]
    table = spark.createDataFrame(ranges, "file string, start long, end long").repartition(max(1, min(len(ranges), 10_000)))

    def scan(batches):
        for batch in batches:
            rows = [
                (r.file, byte, name, bases)
                for r in batch.itertuples()
                for byte, name, bases in _scan_range(r.file, r.start, r.end)
            ]
            yield pd.DataFrame(rows, columns=["file", "start", "name", "bases"])

    # One row per range and per header: these windows sort an index, not sequence.
    runs = table.mapInPandas(scan, "file string, start long, name string, bases long")
    in_file = Window.partitionBy("file").orderBy("start")
    named = runs.withColumn("chrom", F.last("name", True).over(in_file)).withColumn(
        "_contig", F.count("name").over(in_file)
    )
    before = Window.partitionBy("file", "_contig").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return (
        named.withColumn("first", F.coalesce(F.sum("bases").over(before), F.lit(0).cast("long")))
        .where("bases > 0 AND chrom IS NOT NULL")
        .select("file", "chrom", "first", "bases", "start")
    )


def _sequence(f, start: int, bases: int) -> bytes:
    """`bases` letters from byte `start` on, or fewer if a header or the end of the file comes first."""
    f.seek(start)
    out, missing = [], bases
    while missing > 0:
        block = f.read(missing + missing // 32 + 64)
        if not block:
            break
        stop = block.find(b">")
        letters = (block if stop < 0 else block[:stop]).translate(None, _BLANK)[:missing]
        out.append(letters)
        missing -= len(letters)
        if stop >= 0:
            break
    return b"".join(out)


def _piece_chunks(f, piece, chunk: int) -> Iterator[tuple[str, int, int, str, int]]:
    """Chunks that begin in the piece; the last one is completed from the bytes behind it."""
    skip = -piece.first % chunk
    if skip >= piece.bases:
        return
    border = -(piece.first + piece.bases) % chunk
    letters = _sequence(f, piece.start, piece.bases + border)[skip:]
    first = piece.first + skip
    for i in range(0, len(letters), chunk):
        at = first + i
        yield piece.chrom, at // chunk, at, letters[i:i + chunk].decode("ascii"), chunk


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Chunk table of a FASTA file; letter case is kept. Uses `<path>.fai` where there is one."""
    if exists(path + ".fai"):
        pieces = _pieces_from_index(read_fai(spark, path + ".fai"), path, piece_bytes, chunk)
    else:
        pieces = _pieces_by_scan(spark, path, piece_bytes)

    def read(batches):
        for batch in batches:
            for file, group in batch.groupby("file", sort=False):
                with open_input(file) as f:
                    for piece in group.itertuples():
                        yield pd.DataFrame(_piece_chunks(f, piece, chunk), columns=CHUNK_TABLE.names)

    return pieces.repartition("file", "chrom", "first").mapInPandas(read, CHUNK_TABLE)
