"""Graphs of overlaps: reduction, paths, scaffolds. Edges are rows (a, b) with a size or score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .graph import connected_components


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (a, b), of largest size; an edge to itself goes."""
    return edges.filter("a <> b").groupBy("a", "b").agg(F.max("size").alias("size"))


def reduced_edges(edges: DataFrame) -> DataFrame:
    """Edges without those that two others make up: a to c goes where a to b and b to c are there."""
    e = edges.select("a", "b").distinct()
    through = e.withColumnRenamed("b", "mid").join(e.select(F.col("a").alias("mid"), "b"), "mid").select("a", "b").distinct()
    return edges.join(through, ["a", "b"], "left_anti")


def chains(edges: DataFrame) -> DataFrame:
    """(chain, node): nodes on paths without a branch, named by the smallest node; only edges that are their start's only way out and their end's only way in count."""
    e = edges.select("a", "b").distinct()
    out = e.groupBy("a").agg(F.count("*").alias("n_out"))
    into = e.groupBy("b").agg(F.count("*").alias("n_in"))
    plain = e.join(out, "a").join(into, "b").filter("n_out = 1 AND n_in = 1").select("a", "b")
    return connected_components(plain).select(F.col("component").alias("chain"), "node")


def highest_paths(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node, score, hops): the highest sum of sizes of a path that ends at each node of a graph without circles.

    Each round takes all paths one edge further; only nodes whose score has risen go on. Circles are an error.
    """
    e = written(best_edges(edges), "edges")
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    n = nodes.count()
    best = written(nodes.select("node", F.lit(0).cast("bigint").alias("score"), F.lit(0).alias("hops")), "paths")
    front = best
    for _ in range(min(most_rounds, n) + 1):
        further = front.join(e, front["node"] == e["a"]).select(F.col("b").alias("node"), (F.col("score") + F.col("size")).cast("bigint").alias("score"), (F.col("hops") + 1).alias("hops"))
        offer = further.groupBy("node").agg(F.max(F.struct("score", "hops")).alias("o"))
        joined = written(best.join(offer, "node", "left").withColumn("rise", F.coalesce(F.col("o.score") > F.col("score"), F.lit(False))), "offers")
        score, hops = F.when(F.col("rise"), F.col("o.score")).otherwise(F.col("score")), F.when(F.col("rise"), F.col("o.hops")).otherwise(F.col("hops"))
        best = joined.select("node", score.alias("score"), hops.cast("int").alias("hops"))
        front = joined.filter("rise").select("node", F.col("o.score").alias("score"), F.col("o.hops").cast("int").alias("hops"))
        if front.isEmpty():
            return best
    raise ValueError("paths grow without end: the graph has a circle")


def scaffold_edges(pairs: DataFrame, least: int) -> DataFrame:
    """(a, b, n, gap): contigs that at least `least` read pairs link, the smaller name first, with their mean distance. pairs: contig1, contig2, gap."""
    p = pairs.filter("contig1 <> contig2").select(F.least("contig1", "contig2").alias("a"), F.greatest("contig1", "contig2").alias("b"), "gap")
    return p.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("gap").alias("gap")).filter(F.col("n") >= least)


def scaffold_sets(edges: DataFrame) -> DataFrame:
    """(scaffold, contigs, links): components of the links with how many contigs and links each has."""
    c = connected_components(edges.select("a", "b"))
    sizes = c.groupBy("component").agg(F.count("*").alias("contigs"))
    links = edges.join(c, edges["a"] == c["node"]).groupBy("component").agg(F.count("*").alias("links"))
    return sizes.join(links, "component").select(F.col("component").alias("scaffold"), "contigs", "links")


def contigs(seqs: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(contig, n, seq): sequences (id, seq) along paths without a branch as one, and the others as they are.

    overlaps (a, b, size): the last `size` characters of a begin b. A contig is a row: its parts are gathered in it.
    """
    e = best_edges(overlaps)
    named = written(chains(e), "chains")
    plain = e.join(named.select(F.col("node").alias("a"), F.col("chain").alias("_ca")), "a").join(named.select(F.col("node").alias("b"), F.col("chain").alias("_cb")), "b").filter("_ca = _cb").select("a", "b", "size")
    plain = written(plain, "chained")
    place = highest_paths(plain.withColumn("size", F.lit(1)).select("a", "b", "size")).select(F.col("node").alias("id"), "hops")
    part = seqs.join(place, "id", "left").join(named.select(F.col("node").alias("id"), "chain"), "id", "left").join(plain.select(F.col("b").alias("id"), F.col("size").alias("shared")), "id", "left")
    rest = F.substring(F.col("seq"), (F.coalesce("shared", F.lit(0)) + 1).cast("int"), F.char_length("seq"))
    d = part.groupBy(F.coalesce("chain", "id").alias("contig")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce("hops", F.lit(0)).alias("at"), rest.alias("rest")))).alias("parts"))
    return d.select("contig", "n", F.array_join(F.transform("parts", lambda x: x["rest"]), "").alias("seq"))
