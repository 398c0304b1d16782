"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a min-aggregate and a join; no node's neighbours are gathered in one place.
The number of steps grows with the logarithm of the longest path. State goes to the
shared folder between steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the smallest of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` pairs to ``node, root``: the smallest node of the component of every node
    that is not itself the root. Pairs may repeat and run either way; loops are ignored."""
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    key = F.xxhash64("a", "b").cast("decimal(38,0)")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(key).alias("h")).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        if seen["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "edges")
