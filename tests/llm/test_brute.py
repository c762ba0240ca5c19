"""Operators against plain versions on small random tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paircall.llm import components, decontamination, line_dedup, mixing, simhash, suffix_dedup, token_records, topk
from paircall.llm.common import words


def texts(seed, n, alphabet=("the", "of", "and", "red", "blue", "x", "longer", "words,")):
    draw = random.Random(seed)
    pool = [" ".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(n // 2)]
    out = []
    for _ in range(n):
        text = draw.choice(pool)
        cut = draw.randint(0, len(text))
        out.append(draw.choice([text, text[:cut] + draw.choice(pool), text[cut:] + "\n" + text, text.replace("of", "OF", 1)]))
    return out


def docs_of(spark, found, source="s"):
    rows = [(i, t, f"{source}{i % 4}") for i, t in enumerate(found)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


@pytest.mark.parametrize("seed", range(2))
def test_suffix_dedup(spark, seed):
    found = texts(seed, 60)
    data = [t.encode() for t in found]
    least = {}
    for i, t in enumerate(data):
        for a in range(len(t) - 49):
            least.setdefault(t[a : a + 50], i)
    got = {r.row.doc_id: r for r in suffix_dedup.deduplicate(docs_of(spark, found)).collect()}
    for i, t in enumerate(data):
        gone = np.zeros(len(t), dtype=bool)
        for a in range(len(t) - 49):
            if least[t[a : a + 50]] < i:
                gone[a : a + 50] = True
        assert bytes(got[i].kept) == bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert got[i].n_removed == gone.sum()


def test_runs_do_not_depend_on_parts(monkeypatch):
    text = " ".join(texts(5, 40)).encode()
    whole = suffix_dedup.Runs([text])
    covered = Counter(zip(whole.anchor.tolist(), (whole.first + whole.count).tolist(), strict=True))
    monkeypatch.setattr(suffix_dedup, "PART", 777)
    parts = list(suffix_dedup.parts(text))
    assert len(parts) > 2
    starts = sorted(at + f + k for at, part in parts for runs in [suffix_dedup.Runs([part])] for f, n in zip(runs.first, runs.count, strict=True) for k in range(n))
    assert starts == list(range(len(text) - 49)) and sum(whole.count) == len(text) - 49 and covered


def test_refine_against_sets():
    draw = random.Random(1)
    pieces = [bytes(draw.choice(b"ab") for _ in range(draw.randint(50, 84))) for _ in range(40)]
    pieces += [p[:20] + pieces[0][20:50] + p[20:40] for p in pieces[:5]]
    pieces = [p for p in pieces if len(p) >= 50] + pieces[:3]
    doc = np.arange(len(pieces))[::-1].copy()
    sizes = np.array([len(p) - 49 for p in pieces])
    begins = np.cumsum([0] + [len(p) for p in pieces[:-1]])
    owner = np.repeat(np.arange(len(pieces)), sizes)
    starts = np.concatenate([b + np.arange(n) for b, n in zip(begins, sizes, strict=True)])
    gone = suffix_dedup.refine(b"".join(pieces), starts, doc, owner)
    data = b"".join(pieces)
    least = defaultdict(lambda: 10**9)
    for s, o in zip(starts, owner, strict=True):
        least[data[s : s + 50]] = min(least[data[s : s + 50]], doc[o])
    assert gone.tolist() == [bool(doc[o] > least[data[s : s + 50]]) for s, o in zip(starts, owner, strict=True)] and gone.any()


def reachable(values, radius):
    """Smallest index in the component of each fingerprint."""
    values, root = np.array(values, dtype=np.uint64), list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values[a + 1 :] ^ values[a]) <= radius) + a + 1:
            x, y = sorted((find(a), find(int(b))))
            root[y] = x
    return [find(a) for a in range(len(values))]


def near(seed, n):
    """Fingerprints in chains and balls, so that components are longer than one step."""
    draw = random.Random(seed)
    out = [draw.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        value = draw.choice(out)
        for bit in draw.sample(range(64), draw.randint(1, 6)):
            value ^= 1 << bit
        out.append(value)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("segments", (1, 2, 5))
def test_links(spark, segments, monkeypatch):
    values = near(segments, 400)
    monkeypatch.setattr(simhash, "SHARD", 30)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    points = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(points, 4, segments)).collect()}
    expected = defaultdict(set)
    for value, top in zip(signed, reachable(values, 4), strict=True):
        expected[top].add(value)
    got = defaultdict(set)
    for value in signed:
        got[roots.get(value, value)].add(value)
    assert sorted(map(sorted, expected.values())) == sorted(map(sorted, got.values()))
    assert all(min(group) == name for name, group in got.items())


@pytest.mark.parametrize("segments", (2, 5))
def test_links_in_dense_shard(spark, segments, monkeypatch):
    """One segment equal in nine of ten fingerprints: its shard goes through second trees, and these need blocks too."""
    monkeypatch.setattr(simhash, "SHARD", 20)
    monkeypatch.setattr(simhash, "SPLIT", 40)
    mask = simhash.masks(segments)[0]
    values = list(dict.fromkeys(v & ~mask if i % 10 else v for i, v in enumerate(near(segments + 20, 600))))
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    points = spark.createDataFrame([(v,) for v in signed], "fp long")
    seen = []
    tree = simhash.Tree
    monkeypatch.setattr(simhash, "Tree", lambda sample, m, seed: seen.append(m) or tree(sample, m, seed))
    roots = {r.node: r.root for r in components.components(simhash.links(points, 4, segments)).collect()}
    tops = dict(zip(signed, reachable(values, 4), strict=True))
    groups = defaultdict(list)
    for value, top in tops.items():
        groups[top].append(value)
    assert [roots.get(v, v) for v in signed] == [min(groups[tops[v]]) for v in signed]
    assert set(simhash.masks(segments, mask)) <= set(seen[segments:])
    assert any(len(g) > 1 for g in groups.values())


@pytest.mark.parametrize("segments", (2, 3, 5))
def test_segments_cover_other_bits(segments):
    for mask in simhash.masks(segments):
        parts = simhash.masks(segments, mask)
        assert sum(parts) == (1 << 64) - 1 - mask and not any(a & b for i, a in enumerate(parts) for b in parts[:i])


@pytest.mark.parametrize("segments", (1, 3, 5))
def test_partners_share_a_shard(segments):
    points = np.array(near(9, 300), dtype=np.uint64)
    trees = [simhash.Tree(points[:100], m, 1) for m in simhash.masks(segments)]
    homes = [defaultdict(set) for _ in points]
    for number, tree in enumerate(trees):
        for at, leaf in zip(*tree.shards(points, 4 // segments), strict=True):
            homes[at][number].add(int(leaf))
    for a in range(len(points)):
        for b in np.flatnonzero(np.bitwise_count(points ^ points[a]) <= 4):
            assert any(homes[a][t] & homes[int(b)][t] for t in range(segments))


def test_long_chain(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 90), (101, 90), (101, 95), (100, 92)], "node long, to long")
    found = {r.node: r.root for r in components.components(chain).collect()}
    assert {found[i] for i in range(1, 61)} == {0} and {found[i] for i in (92, 95, 100, 101)} == {90}


def test_fingerprint():
    import xxhash

    for text in ("", "one", "One two THREE", " ".join(texts(3, 20))):
        parts = words(text)
        shingles = [" ".join(parts[i : i + 4]) for i in range(len(parts) - 3)] or ([" ".join(parts)] if parts else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return min(row)


def test_edit_distance():
    draw = random.Random(4)
    for _ in range(200):
        pattern = "".join(draw.choice("abc") for _ in range(draw.randint(1, 90)))
        text = "".join(draw.choice("abc") for _ in range(draw.randint(0, 120)))
        least, begin, end = decontamination.best_span(pattern, text)
        assert least == distance(pattern, text)
        assert least == len(pattern) or distance(pattern, text[begin:end]) == least


def test_edits_are_found(spark):
    draw = random.Random(8)
    items = ["".join(draw.choice("abcdefgh ") for _ in range(n)) for n in (15, 60, 100, 240)]
    rows, expected = [], set()
    for number in range(80):
        item = draw.randrange(len(items))
        passage = list(items[item])
        for _ in range(draw.randint(0, len(passage) // 20)):
            at = draw.randrange(len(passage))
            passage[at : at + 1] = draw.choice([[], ["Z"], [passage[at], "q"]])
        text = "".join(draw.choice("xyz ") for _ in range(draw.randint(0, 300)))
        rows.append((number, text + "".join(passage).upper() + text))
    for number, text in rows:
        for i, item in enumerate(items):
            if distance(item, text.lower()) <= len(item) // 20:
                expected.add((number, i))
    found = decontamination.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.row.doc_id, r.item_id) for r in found} == expected and len(expected) >= 80
    for r in found:
        assert distance(items[r.item_id], dict(rows)[r.row.doc_id].lower()) == r.distance


def test_item_groups(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "GROUP", 40)
    items = spark.createDataFrame([(i, chr(97 + i) * 25) for i in range(10)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {chr(97 + i) * 25} after") for i in range(20)], "doc_id long, text string")
    assert {r.row.doc_id for r in decontamination.find(docs, items).collect()} == set(range(10))
    assert {r.doc_id for r in decontamination.clean(docs, items).collect()} == set(range(10, 20))


def test_line_dedup(spark):
    draw = random.Random(2)
    found = ["\n".join(draw.choice("abcd ") for _ in range(draw.randint(0, 12))) for _ in range(80)]
    got = {r.row.doc_id: r for r in line_dedup.deduplicate(docs_of(spark, found)).collect()}
    import hashlib

    order = sorted((i, hashlib.md5(t.encode()).hexdigest(), t) for i, t in enumerate(found))
    first = set()
    for i, _, text in order:
        lines = text.split("\n")
        gone = set()
        for a in range(len(lines) - 2):
            window = tuple(lines[a : a + 3])
            if "".join(window).strip(" "):
                gone |= set(range(a, a + 3)) if window in first else set()
                first.add(window)
        assert got[i].kept == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert sum(s.last - s.first + 1 for s in got[i].spans) == got[i].n_removed == len(gone)


def test_mixing_shares(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice("aaaaabcd") if i % 9 else None, " ".join("w" * draw.randint(0, 30))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mix(docs, ["doc_id", "source"]).collect()
    size = Counter()
    for _, s, t in rows:
        size[s] += len(t.split())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate([*sorted(s for s in size if s), None])}
    left, target, free = 1.5 * sum(size.values()), {}, set(size)
    while free:  # plain water-filling
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * size[s]}
        for s in full or free:
            target[s] = 2.0 * size[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    taken = Counter()
    for r in found:
        assert r.target == pytest.approx(target[r.row.source], rel=1e-12) and r.taken in (0, r.size, 2 * r.size)
        taken[r.row.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 60
    again = mixing.mix(docs.repartition(5), ["doc_id", "source"]).collect()
    assert {(r.row.doc_id, r.taken) for r in again} == {(r.row.doc_id, r.taken) for r in found}


def test_token_records(spark, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    found = texts(7, 50) + ["", "  two  spaces", "tab\there", "<|endoftext|>", "a b 　c", "it's 12,5 é\n\nx "]
    folder = f"{tmp_path}/records"
    token_records.write(docs_of(spark, found), folder, vocabulary)
    plain = Tokenizer.from_file(vocabulary)
    plain.encode_special_tokens = True
    at, ids = 0, {}
    rows = token_records.read(spark, folder, ("doc_id", "start", "n_tokens", "ids", "ids_crc32")).collect()
    assert [r.doc_id for r in rows] == list(range(len(found)))
    for r, text in zip(rows, found, strict=True):
        ids[r.doc_id] = plain.encode(text, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids[r.doc_id]), ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    turns = token_records.shuffled(spark, folder, seed=1).collect()
    assert [r.turn for r in turns] == sorted(r.turn for r in turns) and [r.doc_id for r in turns] != list(range(len(found)))
    assert {r.doc_id: r.ids for r in turns} == ids


def test_damaged_record():
    import io

    data = token_records.frame(b"payload") + token_records.frame(b"")
    assert list(token_records.unframe(io.BytesIO(data))) == [b"payload", b""]
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(token_records.unframe(io.BytesIO(bytes(broken))))
    with pytest.raises(ValueError):
        list(token_records.unframe(io.BytesIO(data[:-1])))


@pytest.mark.parametrize("spread", (1.0, 0.02))
def test_topk(spark, spread, monkeypatch):
    """Wide clouds keep most pairs open, narrow ones prune to single pairs."""
    monkeypatch.setattr(topk, "VECTORS", 300)
    monkeypatch.setattr(topk, "QUERIES", 7)
    draw = np.random.default_rng(3)
    centers = draw.normal(size=(12, 32))
    data = centers[draw.integers(0, 12, 1500)] + spread * draw.normal(size=(1500, 32))
    data[40:60] = data[0]  # ties
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(data)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    whole = np.floor(1024 * data.astype(np.float32).astype(float)).astype(np.int64)
    expected = set()
    for q in range(0, 1500, 100):
        score = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:10]
        expected |= {(q, r, int(i), int(score[i])) for r, i in enumerate(order, 1)}
    assert {tuple(r) for r in found} == expected
