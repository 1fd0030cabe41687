"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's chosen neighbours are hung on the smallest node of its neighbourhood.

    A large star hangs the larger neighbours, a small star the smaller ones and the node itself. The minimum comes from a
    partially combined aggregate, so that a node with very many neighbours isn't gathered in one task.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, both.u == least.w)
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node hangs on one node, which hangs on none."""
    n, nodes = edges.agg(F.count("u"), F.count_distinct("u")).first()
    return n == nodes and (n == 0 or edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges(a, b): the smallest node that can be reached.

    Self-loops and nulls are ignored; an empty table gives an empty result. Each round is written to the shared folder.
    Rounds end when only stars are left; at most max_rounds, else a RuntimeError (never a wrong result).
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    # first a small star: where nodes hang on several others, those are joined once instead of for each node
    now = materialize(_star(materialize(now, "cc"), False), "cc")
    for _ in range(max_rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        now = materialize(_star(_star(now, True), False), "cc")
    raise RuntimeError(f"components: not settled in {max_rounds} rounds")
