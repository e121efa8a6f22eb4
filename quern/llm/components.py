"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import join_counted, written


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and none if it is one."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1").isEmpty()


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (a, b), at most ``total``, with m, the least b of each a; hubs meet theirs without a shuffle."""
    return join_counted(rows, rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), ["a"], "n", total).drop("n")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours go to the smallest of it and its neighbours."""
    both = _with_least(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * total)
    return both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    known = _with_least(edges, total)
    moved = known.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(known.where("b = m").select("a", "b")).distinct()


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b long); component is the smallest node reachable.

    Self links and repeats are ignored; an empty table gives an empty result.  Each star is a
    grouping with map-side minima and a join, in which hubs are no single task's work; its edges
    are written to the shared folder, so lineage stays one star long.  Rounds grow with
    the logarithm of a component's size, and edges never grow in number.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    total, turn = edges.count(), 0
    while not _settled(edges):
        if (turn := turn + 1) > rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        edges = written(_large_star(edges, total), "stars")
        edges = written(_small_star(edges, total), "stars")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
