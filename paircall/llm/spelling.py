"""Spelling variants of words, grouped by a trie over letter-group counts.

Words are the runs of letters of all texts that are long and frequent enough. Two words are near if one code point is
inserted, deleted or replaced. The letters are dealt to GROUPS groups of about equal use in the vocabulary; a word's
vector counts its letters by group. An edit adds at most one to one group (the surplus) and takes at most one from one
group (the deficit). The trie arranges words by their counts, group by group, the most used group first. A depth-first
search of a word's vector follows its own counts and spends each of the two budgets at most once; what it meets at the
leaves is verified letter by letter. As being near is symmetric, only the later vector of a pair is looked for: the
surplus is spent before the deficit, so each pair is met from one side, or at a leaf both share.

The trie is cut into shards by Spark: a node of more than SHARD words is split by the next group, so a shard is a
subtree of at most SHARD words. A leaf of more than SHARD words (words of equal vectors) is cut into blocks, and each
word of it searches every block. A word also travels to the other shards that its budgets reach, with what is left of
them. On the driver are only the nodes that are split and their children: at most one split node per SHARD words and
level. In a task, the search is by numpy over many words at once; it goes deep first and cuts wide steps in two, which
bounds its memory. What leaves a task is a count and the best near word for each word, not the pairs.

A word's form is its near word of largest n (ties: smallest by code point), if that is at least FACTOR times the word's
n. Forms have ever larger n, so following them ends; the last one is the root, found by jumping over parents' parents.

Defined results: null and empty texts have no words; a null doc_id counts as an empty string before the colon; rows
that repeat a doc_id count each. Very long runs are words like any other. Counts above 255 in a vector count as 255,
which keeps near vectors near. An empty table, or one without words, gives an empty result. Only `doc_id` and `text`
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _UPPER, stored

# Letters of words, and which words count.
LETTER = "[A-Za-zÀ-ÿ]"
LETTERS, TIMES, FACTOR, DROP = 6, 5, 5, 199
GROUPS = 16
SHARD = 20_000
WIDE = 1 << 18  # pairs of a word and a node, or of two words, that a step of the search holds
BYTES = 1 << 24  # letters of the pairs that are verified at once
MOST = 255
# What a step may do to a count in each state of the budgets (0: none spent, 1: the surplus, 2: both): (change, state).
STEPS = {0: ((0, 0), (1, 1)), 1: ((0, 1), (-1, 2)), 2: ((0, 2),)}
SHIFT = {(before, after): change for before, steps in STEPS.items() for change, after in steps}


def word_counts(docs: DataFrame, letters: int = LETTERS, times: int = TIMES, drop: int = DROP) -> DataFrame:
    """(word, n): every word of at least `letters` code points with at least `times` occurrences."""
    # A run that is too short cannot become a word, as losing a letter makes it shorter.
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"({LETTER}{{{letters},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")))
    less = F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    words = rows.select(F.when(F.col("h") % drop == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def letter_totals(words: DataFrame) -> np.ndarray:
    """How often the words have each letter, by its code point: at most 256 numbers."""

    def task(batches):
        import pyarrow as pa

        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer("".join(batch.column("word").to_pylist()).encode("latin-1"), np.uint8), minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["letter", "n"])

    totals = np.zeros(256, dtype=np.int64)
    for letter, n in words.select("word").mapInArrow(task, "letter long, n long").groupBy("letter").agg(F.sum("n")).collect():
        totals[letter] = n
    return totals


def letter_groups(totals: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each code point: the most used letters begin groups, others join the lightest one; heaviest first."""
    weights, group = np.zeros(groups, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for letter in np.argsort(-totals, kind="stable").tolist():
        at = int(np.argmin(weights))
        group[letter] = at
        weights[at] += max(int(totals[letter]), 1)
    place = np.empty(groups, dtype=np.int64)
    place[np.argsort(-weights, kind="stable")] = np.arange(groups)
    return place[group]


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of the words in one array, where each word begins, and its length."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.cumsum(lengths) - lengths, lengths


def vectors(words: list[str], group: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    letters, _, lengths = flat(words)
    owner = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(owner * groups + group[letters], minlength=len(words) * groups)
    return np.minimum(counts, MOST).astype(np.uint8).reshape(len(words), groups)


def with_vectors(words: DataFrame, group: np.ndarray) -> DataFrame:
    def task(batches):
        import pyarrow as pa

        for batch in batches:
            found = vectors(batch.column("word").to_pylist(), group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.tobytes() for v in found], pa.binary())], names=[*batch.schema.names, "vector"])

    return words.mapInArrow(task, words.select("*").schema.add("vector", "binary"))


class Shards:
    """The upper part of the trie: `split` nodes, and `leaves`, node to (number, blocks). Nodes are prefixes of vectors."""

    def __init__(self, points: DataFrame, size: int = SHARD):
        spark, sizes, level = points.sparkSession, {b"": points.count()}, 0
        self.split, self.leaves, self.depths = set(), {}, []
        self.deepest = 0
        while sizes:
            wide = [node for node, n in sizes.items() if n > size and level < GROUPS]
            self.split.update(wide)
            for node, n in sorted(sizes.items()):
                if node not in self.split:
                    self.leaves[node] = (len(self.depths), -(-n // size))
                    self.depths.append(level)
            self.deepest, level = level, level + 1
            if not wide:
                break
            parents = spark.createDataFrame([(bytearray(node),) for node in wide], "parent binary")
            below = points.select(F.expr(f"substring(vector, 1, {level - 1})").alias("parent"), F.expr(f"substring(vector, 1, {level})").alias("node"))
            # At most one parent per `size` words.
            counts = below.join(F.broadcast(parents), "parent", "left_semi").groupBy("node").count().collect()
            sizes = {bytes(r["node"]): r["count"] for r in counts}

    def reached(self, vector: bytes) -> list[tuple[int, int, int]]:
        """(shard, blocks, state) of every shard that a search from the root comes to; the own one has state 0."""
        found, todo = [], [(b"", 0)]
        while todo:
            node, state = todo.pop()
            if node in self.leaves:
                found.append((*self.leaves[node], state))
            elif node in self.split:
                count = vector[len(node)]
                todo += [(node + bytes([count + change]), after) for change, after in STEPS[state] if 0 <= count + change <= MOST]
        return found


class Trie:
    """The trie of sorted vectors; each level has its nodes as sorted keys, parent * 256 + count."""

    def __init__(self, rows: np.ndarray):
        node, new = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=bool)
        new[:1] = True
        self.levels = []
        for column in rows.T:
            new[1:] |= column[1:] != column[:-1]
            self.levels.append((node * 256 + column)[new])
            node = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(rows))

    def search(self, probes: np.ndarray, states: np.ndarray, wide: int = WIDE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(probe, row, state) of what probes meet at the leaves, depth first, in parts of about `wide`."""
        todo = [(0, np.arange(len(probes)), np.zeros(len(probes), dtype=np.int64), states)]
        while todo:
            level, at, node, state = todo.pop()
            if len(at) > wide:
                half = len(at) // 2
                todo += [(level, at[half:], node[half:], state[half:]), (level, at[:half], node[:half], state[:half])]
            elif level == len(self.levels):
                yield from self._met(at, node, state, wide)
            elif len(at):
                keys, count, found = self.levels[level], probes[at, level].astype(np.int64), []
                for (before, after), change in SHIFT.items():
                    some = np.flatnonzero((state == before) & (count + change >= 0) & (count + change <= MOST))
                    wanted = node[some] * 256 + count[some] + change
                    child = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    there = keys[child] == wanted
                    found.append((at[some[there]], child[there], np.full(int(there.sum()), after, dtype=states.dtype)))
                todo.append((level + 1, *(np.concatenate(parts) for parts in zip(*found, strict=True))))

    def _met(self, at, node, state, wide):
        sizes = self.last[node] - self.first[node]
        part = np.cumsum(sizes) // wide
        for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
            n = sizes[cut]
            rows = np.arange(n.sum()) + np.repeat(self.first[node[cut]] - np.cumsum(n) + n, n)
            yield np.repeat(at[cut], n), rows, np.repeat(state[cut], n)


def near(letters: np.ndarray, begins: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words a[i] and b[i] differ by exactly one letter that is replaced, or that one of them has more."""
    result = np.zeros(len(a), dtype=bool)
    a, b = np.where(lengths[a] > lengths[b], (b, a), (a, b))
    more = lengths[b] - lengths[a]
    todo = np.flatnonzero((more == 0) | (more == 1))
    todo = todo[np.argsort(lengths[a[todo]], kind="stable")]
    at = 0
    while at < len(todo):
        # Pairs of about equal length together, as many as BYTES hold.
        part = todo[at : at + max(1, BYTES // int(lengths[a[todo[min(len(todo), at + 4096) - 1]]] + 1))][:4096]
        at += len(part)
        width = int(lengths[a[part]].max())
        place = np.arange(width)
        inside = place < lengths[a[part]][:, None]
        one = letters[np.minimum(begins[a[part]][:, None] + place, len(letters) - 1)]
        other = begins[b[part]][:, None] + place
        differ = (one != letters[np.minimum(other, len(letters) - 1)]) & inside
        replaced = differ.sum(1) == 1
        # With a letter more: from the first difference on, b's letters come one later.
        after = np.logical_or.accumulate(differ, axis=1) & inside
        late = (one != letters[np.minimum(other + 1, len(letters) - 1)]) & after
        result[part] = np.where(more[part] == 0, replaced, ~late.any(1))
    return result


def near_words(points: DataFrame, size: int = SHARD) -> DataFrame:
    """(word, n_near, best): best is (-n, word) of the best near word. `points`: stored (word, n, vector)."""
    shards = Shards(points, size)
    depths, deepest = shards.depths, shards.deepest

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            seen, rows = {}, []
            words = batch.column("word").to_pylist()
            for at, (word, vector) in enumerate(zip(words, batch.column("vector").to_pylist(), strict=True)):
                head = vector[:deepest]
                if (found := seen.get(head)) is None:
                    found = seen[head] = shards.reached(vector)
                for shard, blocks, state in found:
                    own = hash_of(word) % blocks if state == 0 else -1
                    rows += [(at, shard, block, own, state) for block in range(blocks)]
            taken = np.array(rows, dtype=np.int64).reshape(-1, 5)
            columns = [batch.take(pa.array(taken[:, 0])).column(c) for c in ("word", "n", "vector")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, taken[:, 1:].T), *columns], names=["shard", "block", "own", "state", "word", "n", "vector"])

    def meet(key, part):
        import pyarrow as pa

        shard, block = (k.as_py() for k in key)
        part = part.sort_by("vector")
        held = np.frombuffer(b"".join(part["vector"].to_pylist()), np.uint8).reshape(len(part), GROUPS)[:, depths[shard] :]
        own, state, n = (part[c].to_numpy() for c in ("own", "state", "n"))
        rows = np.flatnonzero(own == block)
        words = part["word"].to_pylist()
        letters, begins, lengths = flat(words)
        pairs = []
        for probe, row, spent in Trie(held[rows]).search(held, state) if len(rows) else ():
            row = rows[row]
            # Of two words with equal vectors, one looks for the other.
            once = (spent > 0) | (own[probe] < block) | ((own[probe] == block) & (probe < row))
            probe, row = probe[once], row[once]
            real = near(letters, begins, lengths, probe, row)
            pairs.append((probe[real], row[real]))
        one = np.concatenate([p for pair in pairs for p in pair]) if pairs else np.empty(0, np.int64)
        other = np.concatenate([p for pair in pairs for p in pair[::-1]]) if pairs else np.empty(0, np.int64)
        found, counts = np.unique(one, return_counts=True)
        place = np.empty(len(words), dtype=np.int64)
        place[sorted(found.tolist(), key=words.__getitem__)] = np.arange(len(found))
        order = np.lexsort((place[other], -n[other], one))
        best = other[order][np.searchsorted(one[order], found)]
        columns = [pa.array([words[i] for i in at], pa.string()) for at in (found, best)]
        return pa.table({"word": columns[0], "n_near": counts.astype(np.int64), "near_n": n[best], "near": columns[1]})

    dealt = points.mapInArrow(deal, "shard long, block long, own long, state long, word string, n long, vector binary")
    met = dealt.groupBy("shard", "block").applyInArrow(meet, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(word.encode())


def variants(words: DataFrame, size: int = SHARD, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of distinct (word, n)."""
    words = stored(words, "words")
    points = stored(with_vectors(words, letter_groups(letter_totals(words))), "vectors")
    found = words.join(near_words(points, size), "word", "left")
    formed = -F.col("best.less") >= factor * F.col("n")
    form, form_n = F.when(formed, F.col("best.near")), F.when(formed, -F.col("best.less"))
    table = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), form_n.alias("form_n")), "forms")
    roots = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    moved = True
    while moved:
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        jumped = roots.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        jumped = stored(jumped, "roots")
        moved, roots = not jumped.where("moved").isEmpty(), jumped.select("word", "root")
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(word_counts(docs))


# CRC-32 by its published polynomial, bytes from hexadecimal digits.
CRC_TABLE = """
SELECT list(v ORDER BY i) AS crc FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v
  FROM range(256) r(i))"""


def crc_sql(value: str) -> str:
    digit = "strpos('0123456789ABCDEF', substr(hex({0}), (2 * i + {1})::INT, 1)) - 1"
    each = f"lambda i: ({digit.format(value, 1)}) * 16 + {digit.format(value, 2)}"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({value}))), {each})),"
        " lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1])))"
    )


OP11_SQL = f"""
WITH RECURSIVE t AS ({CRC_TABLE}),
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc,
         unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{LETTER}+')) AS run
  FROM documents),
d AS (SELECT doc, run, doc || ':' || run AS s, count(*) AS k FROM r WHERE length(run) >= {LETTERS} GROUP BY doc, run),
h AS (SELECT run, k, {crc_sql("s")} AS h FROM d, t),
w AS (
  SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word,
         sum(k)::BIGINT AS n
  FROM h GROUP BY word HAVING n >= {TIMES} AND length(word) >= {LETTERS}),
p AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
x AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, (i + 2)::INT) AS less, substr(word, 1, i::INT) || '*' || substr(word, (i + 2)::INT) AS masked
  FROM p),
e AS (
  SELECT DISTINCT * FROM (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.masked = b.masked AND a.word <> b.word
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM x a JOIN w b ON a.less = b.word
    UNION ALL SELECT b.word, b.n, a.word, a.n FROM x a JOIN w b ON a.less = b.word)),
b AS (
  SELECT word, count(*) AS n_near, max(near_n) AS best FROM e GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
         (SELECT min(e.near) FROM e WHERE e.word = w.word AND e.near_n = b.best AND b.best >= {FACTOR} * w.n) AS form,
         CASE WHEN b.best >= {FACTOR} * w.n THEN b.best END AS form_n
  FROM w LEFT JOIN b ON w.word = b.word),
c AS (
  SELECT word, word AS root, 0 AS far FROM f
  UNION ALL SELECT c.word, f.form, far + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n
FROM f JOIN (SELECT word, arg_max(root, far) AS root FROM c GROUP BY word) l ON f.word = l.word
"""
