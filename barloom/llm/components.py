"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import settle


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Connects the larger neighbours of each node to the least of the node and its neighbours."""
    near = _both(edges)
    least = settle(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connects the smaller neighbours of each node, and the node, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = settle(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: numbers); the component is its least node.

    Each round aggregates neighbours to minima before joining, so a node with many neighbours is no group of its
    own; minima and edges are written out, so the planner may broadcast small ones and split a hot node's edges
    in the join. The edge table does not grow. Rounds follow the logarithm of the longest path. Loops and
    repeated edges are allowed.
    """
    def clean(e: DataFrame) -> DataFrame:
        return settle(e.filter("a <> b").distinct(), "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = clean(edges.select("a", "b"))
    before = state(now)
    while before[0]:
        now = clean(_small_star(clean(_large_star(now))))
        after = state(now)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
