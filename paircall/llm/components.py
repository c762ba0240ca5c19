"""Connected components of a link table whose links point from a larger to a smaller number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest number reachable, for every node that has a link to a smaller one.

    `links` has `node` and `to`, longs, to < node. In each round a node keeps its smallest neighbour, and its other
    neighbours are linked to that one instead. This keeps what is connected, and links only ever move to smaller
    numbers, so in the end every node has one link: a forest. Roots are then found by jumping to the parent's parent.
    No neighbour list is gathered; rounds are few as long as `links` are stars of local groups. Each round is stored.
    """
    links = stored(links.distinct(), "links")
    while True:
        least = F.min("to").over(Window.partitionBy("node"))
        sided = links.withColumn("least", least)
        pairs = sided.select(
            F.when(F.col("to") == F.col("least"), F.col("node")).otherwise(F.col("to")).alias("node"), F.col("least").alias("to")
        )
        after = stored(pairs.distinct(), "links")
        counts = after.agg(F.count("*").alias("links"), F.count_distinct("node").alias("nodes")).first()
        links = after
        if counts["links"] == counts["nodes"]:
            break
    roots = links.select("node", F.col("to").alias("root"))
    while True:
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = stored(roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        roots = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return roots
