"""Connected components of a table of links, by alternating large and small stars.

Every round points each node's neighbours to the smallest node that it knows; sums and minima are partially
aggregated, and a node with very many links is joined by broadcast instead of in one task.

The links of a round are a written table, not a checkpoint: a checkpoint keeps the size that the optimizer guessed, a join's
guess is the product of its sides', and over some rounds that number alone fills the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import cut, lookup_join, stored


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (root = the smallest node) for every node of ``links`` (``a, b``: long, not null).

    Links to oneself and repeated links do not count. An empty table gives an empty result.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        # Large star: larger neighbours of a node point to the least of its neighbours and itself.
        edges = cut(lookup_join(both.where("b > a"), least, ["a"], "n", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: smaller neighbours and the node itself point to the least of them.
        least = cut(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        pointed = lookup_join(edges, least, ["a"], "n", "inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(pointed.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    return cut(edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root")))
