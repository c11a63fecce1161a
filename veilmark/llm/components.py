"""Connected components of an edge table, by alternating star contraction in Spark.

Large stars point every larger neighbour at a node's smallest one; small stars point smaller neighbours and the
node itself at the smallest.  The rounds needed grow with the logarithm of the longest chain.  Neighbours are
never gathered: each star is a minimum per node and a join, so that a node with very many links is only many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # a < b in every edge: b's smaller neighbours are its a's
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    moved = joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Edges may repeat, be loops or point either way; null ends are ignored.  No edges: no rows.
    """
    now = written(
        edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    state = None
    for _ in range(max_rounds):
        now = written(_small_star(_large_star(now)), "star")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (tuple(found)) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
