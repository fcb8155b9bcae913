"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("many")).withColumn("m", F.least("a", "m"))
    return scratch.joined(both, least, "a", 2 * total).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them.  Edges go from the
    larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("many"))
    to = scratch.joined(edges, least, "a", total).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return to.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges`` (a, b, of any
    ordered type).  Each step is written to the shared folder; a hub's edges are counted in partial
    sums and meet its smallest neighbour by a broadcast of the hubs, so they are never gathered in one place."""
    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.written(edges, name)
    before = _state(edges)
    while before[0]:
        edges = scratch.written(_small_star(scratch.written(_large_star(edges, before[0]), name), before[0]), name)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
