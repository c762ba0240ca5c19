"""Writes small BAM files and their index for the reader's tests."""

import struct
import zlib

CODES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"


def block(data):
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def bin_of(start, end):
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return offset + (start >> shift)
    return 0


def span(cigar_ops):
    return sum(n for n, op in cigar_ops if op in "MDN=X")


def record(read, contigs, cigar_ops):
    tid = contigs.index(read["chrom"]) if read["chrom"] != "*" else -1
    name = read["qname"].encode() + b"\x00"
    seq = read["seq"] or ""
    cigar = b"".join(struct.pack("<I", n << 4 | OPS.index(op)) for n, op in cigar_ops)
    codes = [CODES.index(c.upper()) if c.upper() in CODES else 15 for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    quals = bytes(ord(c) - 33 for c in read["qual"]) if read["qual"] else b"\xff" * len(seq)
    start = read["pos"]
    number = bin_of(max(start, 0), max(start, 0) + max(span(cigar_ops), 1))
    body = struct.pack(
        "<iiBBHHHiiii", tid, start, len(name), read["mapq"], number, len(cigar_ops), read["flag"], len(seq), -1, -1, 0
    )
    tags = b"RGZgrp\x00" + b"NMC\x05" + b"XSs" + struct.pack("<h", -300) + b"XFf" + struct.pack("<f", 0.5) + b"XBBc" + struct.pack("<i3b", 3, 1, -2, 3) + b"XAAq"
    body += name + cigar + packed + quals + tags
    return struct.pack("<i", len(body)) + body


TAGS = {"RG": "Z:grp", "NM": "i:5", "XS": "i:-300", "XF": "f:0.5", "XB": "B:c,1,-2,3", "XA": "A:q"}


def write(path, reads, contigs, lengths, operations, block_size=300):
    """Coordinate-sorted BAM with small blocks, and its `.bai`. Records may cross block borders."""
    order = {c: i for i, c in enumerate(contigs)}
    reads = sorted(reads, key=lambda r: (order.get(r["chrom"], len(contigs)), r["pos"]))
    text = "@HD\tVN:1.0\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in zip(contigs, lengths))
    header = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    for c, n in zip(contigs, lengths):
        header += struct.pack("<i", len(c) + 1) + c.encode() + b"\x00" + struct.pack("<i", n)
    stream, starts = bytearray(header), []
    for r in reads:
        starts.append(len(stream))
        stream += record(r, contigs, operations(r["cigar"]))
    starts.append(len(stream))
    out, offsets = b"", []
    for i in range(0, len(stream), block_size):
        offsets.append(len(out))
        out += block(bytes(stream[i:i + block_size]))
    offsets.append(len(out))
    virtual = lambda at: offsets[at // block_size] << 16 | at % block_size
    with open(path, "wb") as f:
        f.write(out + block(b""))

    index = b"BAI\x01" + struct.pack("<i", len(contigs))
    for c in contigs:
        bins, linear, mapped, unmapped = {}, {}, 0, 0
        for r, begin, end in zip(reads, starts, starts[1:]):
            if r["chrom"] != c:
                continue
            mapped, unmapped = mapped + (not r["flag"] & 4), unmapped + bool(r["flag"] & 4)
            stop = r["pos"] + max(span(operations(r["cigar"])), 1)
            chunks = bins.setdefault(bin_of(r["pos"], stop), [])
            if chunks and chunks[-1][1] == virtual(begin):
                chunks[-1][1] = virtual(end)
            else:
                chunks.append([virtual(begin), virtual(end)])
            for w in range(r["pos"] >> 14, (stop - 1 >> 14) + 1):
                linear.setdefault(w, virtual(begin))
        index += struct.pack("<i", len(bins) + 1)
        for number, chunks in sorted(bins.items()):
            index += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks)
        index += struct.pack("<IiQQQQ", 37450, 2, 0, 0, mapped, unmapped)
        windows = max(linear, default=-1) + 1
        index += struct.pack("<i", windows) + b"".join(struct.pack("<Q", linear.get(w, 0)) for w in range(windows))
    with open(path + ".bai", "wb") as f:
        f.write(index + struct.pack("<Q", sum(r["chrom"] == "*" for r in reads)))
    return reads
