"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discard, written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges (a, b).

    Alternating star contractions: large stars hang every larger neighbour on a node's smallest
    neighbour, small stars do so with the others. Each round writes its edges to the shared folder,
    so lineage stays short, and needs only aggregates and equi-joins, which AQE splits where a hub is
    hot. Self-loops are ignored; an empty table gives no rows. Rounds grow with the logarithm of the nodes;
    edges that still change after most_rounds are an error, never a wrong answer.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        # Large star: u's larger neighbours go to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).filter(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, large["a"] == low["u"]).select(F.when(F.col("b") == F.col("m"), F.col("u")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        before, now = now, written(small.filter("a > b").distinct(), "edges")
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    members = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
