"""Connected components of an edge table, without collecting a neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b, long):
    component is the smallest id that it can reach.

    Alternating large-star and small-star steps: each is a minimum per node
    (combined before the shuffle) joined back to the node's edges, so a node
    with a third of all edges is split by the skew join like any other key.
    The number of rounds grows with the logarithm of the longest path.
    """
    edges = keep(_ordered(edges.select("a", "b")))
    while not _are_stars(edges):
        edges = keep(_small_star(_large_star(edges)))
    pairs = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return pairs.unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, which hangs on none."""
    ends = edges.selectExpr("a node", "1 up", "0 down").unionByName(edges.selectExpr("b node", "0 up", "1 down"))
    held = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return held.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller id."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node on its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    return _ordered(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _ordered(moved.unionByName(least.select("a", F.col("low").alias("b"))))
