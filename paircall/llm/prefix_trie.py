"""The prefix trie of conversations, as balanced parentheses per shard.

A node is a distinct sequence of first turns (role, text); the root is the empty one. Nodes are named by their depth
and by two sums of 64-bit hashes of (place, role, text) over their turns, so names are prefix sums: they are made in
blocks of BLOCK turns, and no conversation has to be in one task, however long it is.

Equal conversations are merged first; from then on a sequence is a distinct whole conversation and has a weight. The
trie is cut by the number of sequences below a node. Below SHARD, maximal subtrees are dealt to shards, many small ones
to one. The nodes above are the spines that shards share: they are merged in the next round, with a limit SHARD times
higher, where what their subtrees gave is added up per node; the number of rounds is the logarithm of the number of
sequences. Where a node has a single sequence below it, the path that follows branches no more: its first node is a
leaf of the shard, the others follow from running sums of bytes along the conversation.

In a shard the trees are one string of parentheses in depth-first order. `Parentheses` finds the one that closes a
node's by range minima of the excess over blocks, which delimits the subtree; the rank of the pairs "()" counts its
leaves; cumulative arrays over the opening parentheses give its savings, and what rounds before left at its nodes.

Digests of conversations that end at a node are made by a stream over rows sorted by node and conv_id: one state, no
list of a node's members.

Defined results: turns go by turn, null first, then role, then MD5 of the text; null role or text is empty; rows without
a conv_id are no conversation. Rows that repeat are turns of their own. c % 5 has the sign of c, so conv_ids -4 to 4
begin like conversation 0. An empty table gives an empty result, also without root. Only the four columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .spelling import CRC_TABLE, crc_sql

FAMILY, HEAD = 5, 9  # conversations that begin alike, and the modulus of how many turns they share
SHARD = 4096  # sequences of a subtree that goes to one task
NODES = 50_000  # nodes that a shard is given on average
BLOCK = 4096  # turns of a conversation that are summed in one window
EXCESS = 64  # parentheses of a block of the excess
NOTHING = hashlib.sha256().hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, j, role, key, size): turns by place, from 0; key is a digest of the text, size its bytes.

    Places are counted within ranges of the global order, and the counts of the ranges before are added.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.md5(text).alias("key"), F.octet_length(text).cast("long").alias("size"))
    order = [F.col("turn").asc_nulls_first(), "role", "key"]
    ranged = stored(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    counts = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return ranged.withColumn("nth", nth).join(counts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("nth") - 1).alias("j"), "role", "key", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, i, role, key, size), i from 1, and (conv_id, length) of all conversations, from stored `turns`."""
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    own = lengths.select("conv_id", "own", (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % HEAD).alias("h"), F.expr(f"conv_id - conv_id % {FAMILY}").alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = stored(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    heads = turns.where((F.col("j") < HEAD - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("conv_id", "base", "taken"), "base").where("j < taken")
    tails = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("j >= h")
    kept = ["role", "key", "size"]
    rows = heads.select("conv_id", (F.col("j") + 1).alias("i"), *kept).unionByName(tails.select("conv_id", (F.col("taken") + F.col("j") - F.col("h") + 1).alias("i"), *kept))
    return rows, convs.select("conv_id", "length")


def _name(depth: Column, one: Column, other: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, one, other)))


def paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, i, node, parent, size, upto, ended): the nodes of every conversation, the root too; upto sums the sizes."""
    number = lambda seed: F.xxhash64(F.lit(seed), "i", "role", "key").cast("decimal(20,0)")
    rows = turns.withColumns({"a": number(1), "b": number(2), "block": F.expr(f"(i - 1) div {BLOCK}")})
    sums = ["a", "b", "size"]
    inside = Window.partitionBy("conv_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(*(F.sum(c).alias(f"all_{c}") for c in sums))
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in sums))
    rows = rows.withColumns({f"in_{c}": F.sum(c).over(inside) for c in sums}).join(blocks, ["conv_id", "block"])
    a, b, upto = ((F.col(f"before_{c}") + F.col(f"in_{c}")) for c in sums)
    rows = rows.select("conv_id", "i", "size", upto.alias("upto"), a.cast("decimal(38,0)").alias("x"), b.cast("decimal(38,0)").alias("y"), "a", "b")
    x, y, i = F.col("x"), F.col("y"), F.col("i")
    parent = _name(i - 1, (x - F.col("a")).cast("decimal(38,0)"), (y - F.col("b")).cast("decimal(38,0)"))
    rows = rows.select("conv_id", "i", _name(i, x, y).alias("node"), parent.alias("parent"), "size", "upto")
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", zero.alias("i"), _name(*[F.lit(0)] * 3).alias("node"), F.lit(None).cast("binary").alias("parent"), zero.alias("size"), zero.alias("upto"))
    return rows.unionByName(roots).join(lengths, "conv_id").withColumn("ended", F.col("i") == F.col("length")).drop("length")


class Parentheses:
    """A balanced string of parentheses (1 opens, 0 closes) with minima of the excess over blocks and over pairs of these."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        least = [self.excess[i : i + EXCESS].min() for i in range(0, len(bits), EXCESS)]
        self.levels = [np.array(least, dtype=np.int64)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            even = np.append(below, below[-1:]) if len(below) % 2 else below
            self.levels.append(even.reshape(-1, 2).min(1))

    def _first(self, begin: int, end: int, wanted: int) -> int:
        found = np.flatnonzero(self.excess[begin:end] <= wanted)
        return begin + int(found[0]) if len(found) else -1

    def findclose(self, at: int) -> int:
        """The parenthesis that closes the one that opens at `at`: the first later one with less excess than before it."""
        wanted, block = int(self.excess[at]) - 1, at // EXCESS
        if (found := self._first(at + 1, (block + 1) * EXCESS, wanted)) >= 0:
            return found
        # Up while no block to the right holds it, then down to the first that does.
        level, block = 0, block + 1
        while block >= len(self.levels[level]) or self.levels[level][block] > wanted:
            if block % 2 == 0:
                level, block = level + 1, block // 2
            else:
                level, block = level + 1, block // 2 + 1
        while level:
            level, block = level - 1, block * 2
            block += self.levels[level][block] > wanted
        return self._first(block * EXCESS, (block + 1) * EXCESS, wanted)

    def leaf_pairs(self) -> np.ndarray:
        """Where a parenthesis opens that is closed at once."""
        return (self.bits == 1) & np.append(self.bits[1:] == 0, False)


def subtree_sums(parents: np.ndarray, saved: np.ndarray, below_leaves: np.ndarray, below_saved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and savings of every node's subtree; parents[i] is a node's number, -1 for the top of a tree.

    below_* is what subtrees outside of the shard add at a node; one that has such subtrees is no leaf.
    """
    order = np.argsort(parents, kind="stable")
    first, last = (np.searchsorted(parents[order], np.arange(-1, len(parents)), side=side) for side in ("left", "right"))
    bits, opened = bytearray(), []
    todo = order[first[0] : last[0]][::-1].tolist()
    while todo:
        node = todo.pop()
        if node < 0:
            bits.append(0)
            continue
        bits.append(1)
        opened.append(node)
        todo.append(-1)
        todo += order[first[node + 1] : last[node + 1]][::-1].tolist()
    string, opened = Parentheses(np.frombuffer(bytes(bits), np.uint8)), np.array(opened, dtype=np.int64)
    begins = np.flatnonzero(string.bits)
    at = np.zeros((3, len(bits) + 1), dtype=np.int64)
    at[0, begins + 1] = string.leaf_pairs()[begins] & (below_leaves[opened] == 0)
    at[1, begins + 1] = below_leaves[opened]
    at[2, begins + 1] = saved[opened] + below_saved[opened]
    pairs, lower, savings = np.cumsum(at, axis=1)
    ends = np.array([string.findclose(i) for i in begins.tolist()], dtype=np.int64)
    leaves, total = np.empty(len(parents), dtype=np.int64), np.empty(len(parents), dtype=np.int64)
    leaves[opened] = pairs[ends + 1] - pairs[begins] + lower[ends + 1] - lower[begins]
    total[opened] = savings[ends + 1] - savings[begins]
    return leaves, total


def _merged(part):
    """A shard's nodes with leaves and savings of their subtrees."""
    import pyarrow as pa

    number = {node: at for at, node in enumerate(part["node"].to_pylist())}
    parents = np.array([number.get(p, -1) for p in part["parent"].to_pylist()], dtype=np.int64)
    leaves, saved = subtree_sums(parents, *(part[c].to_numpy() for c in ("saving", "below_leaves", "below_saved")))
    return pa.table({"node": part["node"], "parent": part["parent"], "top": parents < 0, "n_leaves": leaves, "saved_tokens": saved})


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conv_ids of each node, ascending, from (node, conv_id): a stream in sorted order."""

    def task(batches):
        import pyarrow as pa

        last, state = None, None
        for batch in batches:
            nodes, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_numpy()
            cuts = [0, *(at for at in range(1, len(nodes)) if nodes[at] != nodes[at - 1]), len(nodes)] if nodes else [0]
            done = []
            for begin, end in zip(cuts, cuts[1:]):
                said = ",".join(map(str, ids[begin:end].tolist())).encode()
                if nodes[begin] == last:
                    state.update(b"," + said)
                    continue
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = nodes[begin], hashlib.sha256(said)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return ends.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(task, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node: node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = stored(paths(turns, lengths), "paths")
    ends = rows.where("ended").select("node", "conv_id", "upto")
    # A sequence is named by its smallest conversation.
    sequences = stored(ends.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("upto").alias("total")), "sequences")
    rows = rows.drop("ended").join(sequences.select("conv_id", "weight", "total"), "conv_id")
    same = [F.first(c, True).alias(c) for c in ("parent", "size")]
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("i").alias("depth"), F.sum("weight").alias("n_convs"), F.count("*").alias("sequences"), *same)
    nodes = stored(nodes, "nodes")
    # A node's owner is its smallest conversation; the first node with one sequence begins the owner's unbranched path.
    known = rows.join(nodes.select("node", "sequences"), "node").select("conv_id", "i", "node", "sequences", "weight", "total", "upto", "size")
    known = stored(known, "known")
    alone = known.where("sequences = 1").select("conv_id", "i", "node", ((F.col("weight") - 1) * (F.col("total") - F.col("upto") + F.col("size"))).alias("saved_tokens"))
    begins = alone.groupBy("conv_id").agg(F.min(F.struct("i", "node", "saved_tokens")).alias("b")).select("b.node", F.col("b.saved_tokens").alias("saving"))
    single = alone.select("node", F.lit(1).cast("long").alias("n_leaves"), "saved_tokens")
    zero = F.lit(0).cast("long")
    branching = nodes.where("sequences > 1").select("node", "parent", "conv_id", "sequences", ((F.col("n_convs") - 1) * F.col("size")).alias("saving"))
    begins = nodes.join(begins, "node").select("node", "parent", "conv_id", "sequences", "saving")
    most = nodes.agg(F.max("sequences")).first()[0] or 0
    low, high, found, below = 0, shard, [], None
    while low < most:
        band = branching.where((F.col("sequences") > low) & (F.col("sequences") <= high))
        band = band if low else band.unionByName(begins)
        tops = known.where(F.col("sequences") <= high).groupBy("conv_id").agg(F.min(F.struct("i", "node"))["node"].alias("top"))
        band = band.join(tops, "conv_id")
        if below is not None:
            added = below.groupBy("parent").agg(F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved"))
            band = band.join(added.withColumnRenamed("parent", "node"), "node", "left")
            band = band.fillna(0, ["below_leaves", "below_saved"])
        else:
            band = band.withColumns({"below_leaves": zero, "below_saved": zero})
        band = stored(band, "band")
        shards = -(-band.count() // NODES)
        dealt = band.withColumn("shard", F.pmod(F.xxhash64("top"), F.lit(max(shards, 1))))
        dealt = dealt.select("shard", "node", "parent", "saving", "below_leaves", "below_saved")
        merged = stored(dealt.groupBy("shard").applyInArrow(_merged, "node binary, parent binary, top boolean, n_leaves long, saved_tokens long"), "merged")
        found.append(merged.select("node", "n_leaves", "saved_tokens"))
        spines = merged.where("top AND parent IS NOT NULL").select("parent", "n_leaves", "saved_tokens")
        below = spines if below is None else below.unionByName(spines)
        low, high = high, high * shard
    result = nodes.drop("sequences", "size")
    for each in found[1:]:
        found[0] = found[0].unionByName(each)
    # Paths that do not branch any more come from their running sums, all others from the shards.
    sums = single if not found else single.unionByName(found[0].join(alone.select("node"), "node", "left_anti"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    result = result.join(sums, "node").join(children, "node", "left").join(above, "parent", "left").join(ends_digests(ends), "node", "left")
    return result.select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(*rebuilt(stored(numbered(conversations), "turns"))).drop("node")


OP13_SQL = f"""
WITH t AS ({CRC_TABLE}),
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS j
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, count(*) AS own, conv_id::VARCHAR AS s FROM o GROUP BY conv_id),
g AS (SELECT conv_id, own, {crc_sql("s")} % {HEAD} AS h FROM l, t),
v AS (
  SELECT g.conv_id, g.own, g.h, g.conv_id - g.conv_id % {FAMILY} AS base, least(g.h, coalesce(l.own, 0)) AS taken
  FROM g LEFT JOIN l ON l.conv_id = g.conv_id - g.conv_id % {FAMILY}),
r AS (
  SELECT v.conv_id, j + 1 AS i, role, text FROM v JOIN o ON o.conv_id = v.base AND j < taken
  UNION ALL SELECT v.conv_id, taken + j - h + 1, role, text FROM v JOIN o ON o.conv_id = v.conv_id AND j >= h),
p AS (
  SELECT conv_id, i, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY i) AS node, octet_length(encode(text)) AS size FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM v),
e AS (SELECT conv_id, max(i) AS i FROM p GROUP BY conv_id),
n AS (SELECT node, min(conv_id) AS conv_id, any_value(i) AS depth, count(*) AS n_convs, any_value(size) AS size FROM p GROUP BY node),
c AS (SELECT left(node, -64) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (
  SELECT p.node, count_if(c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.i <= n.depth LEFT JOIN c ON c.node = n.node GROUP BY p.node),
f AS (SELECT p.node, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends FROM p JOIN e ON e.conv_id = p.conv_id AND e.i = p.i GROUP BY p.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, coalesce(f.ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN c ON c.node = n.node LEFT JOIN f ON f.node = n.node
LEFT JOIN n a ON n.depth > 0 AND a.node = left(n.node, -64)
"""
