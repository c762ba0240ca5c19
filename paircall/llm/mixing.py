"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a flow. Its documents, in a shuffled order, get a virtual finish time: the words of the source up to and
with the document, divided by the source's target. A second pass over the source goes on where the first ended. All
entries are sorted by finish time and cut at the total budget, so every source ends near its target.

No sum runs over a whole source or over all rows in one task. Documents fall into about sqrt(n) buckets of the shuffle
order, and finish times into as many; prefix sums run over the buckets' totals and then inside each bucket. The driver
gets the row count, one bucket with its total, and the last entry taken.

Defined results: a null or empty text has size 0 and takes nothing. A null source is a source of its own, after the
others. Rows that share a doc_id are documents of their own. An empty table gives an empty result. Only `doc_id`,
`source` and `text` are read; other columns are carried as they are, in a struct, so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_of, stored, text_or_empty

WEIGHTS = (5, 2, 1)


def targets(sources: DataFrame, share: float, passes: int, weights: tuple[int, ...]) -> DataFrame:
    """Adds `target` to one row per source (`skey`, `source`, `source_size`).

    The sources' levels rise together, by weight, until the budget is spent; a source stops at `passes` times its size.
    Sorted by the level at which they stop, source i would level off at (budget - stops before it) / (weights from it
    on); that rises up to the first source that does not stop and falls after it, so the level is the maximum.
    """
    everyone = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_stop = Window.orderBy("stop", "skey")
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    level = (F.col("budget") - F.col("stopped")) / F.col("weight_left")
    return (
        sources.select("*", weight.alias("weight"), (F.col("source_size") * passes).alias("most"))
        .withColumn("stop", F.col("most").cast("double") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everyone) * F.lit(float(min(share, passes))))
        .withColumn("stopped", F.coalesce(F.sum("most").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max(level).over(everyone))
        .withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")))
        .select("skey", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    columns: list[str] | None = None,
    share: float = 1.5,
    passes: int = 2,
    weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """One row per document: `row` (a struct of `columns`, by default all), size, source_size, target, copies, taken.

    `share` is the budget as a multiple of all words, `passes` how often a document may be taken. `copies` says how
    often it was, `taken` = copies * size.
    """
    spark = docs.sparkSession
    columns = docs.columns if columns is None else columns
    sized = docs.select(
        row_of(columns),
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")).alias("skey"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
    )
    # Sums and finish times need no text, so the sizes are stored without what is carried.
    light = stored(sized.drop("row") if "text" in columns else sized, "sizes")
    parts = max(1, math.isqrt(light.count()))
    # The first 32 bits of the digest place a document in the shuffled order; the whole digest sorts inside a bucket.
    bucket = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * parts, 32)
    totals = light.groupBy("skey", "source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    totals = stored(totals, "totals")
    sources = totals.groupBy("skey", "source").agg(F.sum("words").alias("source_size"))
    aims = targets(sources, share, passes, weights)
    so_far = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("skey", "bucket", F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("before"))
    starts = stored(starts.join(aims, "skey"), "starts")

    inside = Window.partitionBy("skey", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)

    def timed(rows: DataFrame) -> DataFrame:
        done = F.col("before") + F.sum("size").over(inside)
        return rows.drop("source").withColumn("bucket", bucket).join(starts, ["skey", "bucket"]).withColumn("done", done)

    times_of = stored(timed(light), "timed")
    rows = timed(sized) if "text" in columns else times_of
    times = [(F.col("done") + F.col("source_size") * k) / F.col("target") for k in range(passes)]
    entries = times_of.where("target > 0").select("skey", "h", "size", F.posexplode(F.array(*times)).alias("pass", "time"))
    slot = F.least(F.floor(F.col("time") * parts), F.lit(2 * parts)).cast("long")
    last = _last_taken(entries.withColumn("slot", slot), aims)
    if last is None:
        copies = F.when(F.col("target") > 0, passes).otherwise(0)
    else:
        cut = F.struct(*(F.lit(last[c]).alias(c) for c in ("time", "skey", "h")))
        copies = sum((F.struct(t.alias("time"), "skey", "h") <= cut).cast("int") for t in times)
        copies = F.when(F.col("target") > 0, copies).otherwise(0)
    return rows.select("row", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    found = mix(docs, **settings)
    return found.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def _last_taken(entries: DataFrame, aims: DataFrame):
    """The last entry within the budget, in order of time; None if all are. Bounded: one row per slot, then one slot."""
    budget = aims.agg(F.sum("target")).first()[0] or 0.0
    # Targets are doubles whose sum is a whole number of halves but for rounding.
    budget = round(budget * 2) / 2
    before = F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = entries.groupBy("slot").agg(F.sum("size").alias("words"))
    crossing = (
        slots.withColumn("before", F.coalesce(before, F.lit(0)))
        .where(F.col("before") + F.col("words") > budget)
        .orderBy("slot").limit(1).collect()
    )
    if not crossing:
        return None
    order = Window.orderBy("time", "skey", "pass", "h", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = entries.where(F.col("slot") == crossing[0]["slot"]).withColumn("cum", F.sum("size").over(order) + crossing[0]["before"])
    taken = inside.where(F.col("cum") <= budget).agg(F.max(F.struct("time", "skey", "h")).alias("m")).first()["m"]
    if taken is not None:
        return taken
    # The slot's first entry already exceeds the budget: everything before the slot is taken.
    earlier = entries.where(F.col("slot") < crossing[0]["slot"]).agg(F.max(F.struct("time", "skey", "h")).alias("m")).first()["m"]
    return earlier or {"time": -1.0, "skey": "", "h": ""}


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, ["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '~') AS skey, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT skey, source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY skey, source),
w AS (
  SELECT *, 2 * source_size AS most, (2 * source_size)::DOUBLE / weight AS stop,
         (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM s),
l AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY stop, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS stopped,
         (sum(weight) OVER (ORDER BY stop, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weight_left FROM w),
t AS (
  SELECT skey, source_size, least(most::DOUBLE, weight * max((budget - stopped) / weight_left) OVER ()) AS target FROM l),
r AS (
  SELECT d.doc_id, d.skey, h, size, source_size, target,
         sum(size) OVER (PARTITION BY d.skey ORDER BY h, size ROWS UNBOUNDED PRECEDING)::BIGINT AS done
  FROM d JOIN t ON d.skey = t.skey),
e AS (
  SELECT r.*, pass, (done + pass * source_size)::DOUBLE / target AS finish FROM r, (VALUES (0), (1)) p(pass) WHERE target > 0),
c AS (
  SELECT *, sum(size) OVER (ORDER BY finish, skey, pass, h, size ROWS UNBOUNDED PRECEDING) AS cum FROM e),
k AS (
  SELECT doc_id, h, skey, size, done, sum(size)::BIGINT AS taken FROM c
  WHERE cum <= (SELECT round(2 * sum(target)) / 2 FROM t) GROUP BY ALL)
SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM r LEFT JOIN k ON r.skey = k.skey AND r.h = k.h AND r.done = k.done AND r.size = k.size
"""
