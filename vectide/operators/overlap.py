"""Overlapping shards: replicas of points in further shards, within capacity and budget."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .graphs import symmetrise
from .neighbours import block_search
from .partitioner import partition_graph


def top_moves(edges: DataFrame, assignment: DataFrame, cover: DataFrame, cap: int) -> DataFrame:
    """(id, shard, affinity): for each point the shard most of its neighbours are in, if it has room and hasn't the point yet.

    Neighbours count by their first shard, assignment; ties go to the shard of the nearest neighbour.
    """
    full = cover.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap).select("shard")
    pull = edges.join(assignment.select(F.col("id").alias("dst"), "shard"), "dst").groupBy(F.col("src").alias("id"), "shard").agg(F.count(F.lit(1)).alias("affinity"), F.min("rank").alias("first"))
    free = pull.join(cover, ["id", "shard"], "left_anti").join(F.broadcast(full), "shard", "left_anti")  # one row for each shard
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("affinity"), "first", "shard"))
    return free.withColumn("r", best).where("r = 1").select("id", "shard", "affinity")


def apply_moves(moves: DataFrame, cover: DataFrame, cap: int, budget: int) -> DataFrame:
    """(id, shard) of the moves with the greatest affinity that fit: by id in each shard up to its room, then shard by shard up to the budget."""
    most = moves.agg(F.max("affinity").alias("most"))
    best = moves.crossJoin(most).where(F.col("affinity") == F.col("most"))
    sizes = cover.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("id"))).join(sizes, "shard", "left")
    fits = placed.where(F.col("place") + F.coalesce("n", F.lit(0)) <= cap)
    per = fits.groupBy("shard").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = per.select("shard", F.greatest(F.lit(0), F.least(F.col("m"), F.lit(budget) - before)).alias("take"))
    return fits.join(take, "shard").where(F.col("place") <= F.col("take")).select("id", "shard")


def overlapping_graph_partition(edges: DataFrame, points: DataFrame, k: int, epsilon: float = 0.05, overlap: float = 0.2) -> DataFrame:
    """(id, shard): a graph partition, then rounds of moves with the best affinity, until the budget overlap * n is spent or none is left.

    edges are read in each round, so they should be a written table.
    """
    n = points.count()
    cap, extra = max(1, int((1 + epsilon) * n / k)), int(overlap * n)
    parts = ceil((n + extra) / cap)
    base = materialize(partition_graph(materialize(symmetrise(edges), "graph"), points.select("id", F.lit(1).cast("long").alias("weight")), parts, epsilon), "base")
    cover, left = base, extra
    while left > 0:  # each round adds a replica at least
        more = materialize(apply_moves(top_moves(edges, base, cover, cap), cover, cap, left), "moves")
        added = more.count()
        if not added:
            break
        left -= added
        cover = materialize(cover.unionByName(more), "cover")
    return cover


def shard_ratings(points: DataFrame, representatives: DataFrame, cover: DataFrame, cap: int, keep: int = 5, metric: str = "l2") -> DataFrame:
    """(id, shard, dist): each point's nearest shards by representatives(shard, vec), without its own and those that are full."""
    full = cover.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap).select("shard")
    reps = representatives.join(full, "shard", "left_anti").select(F.monotonically_increasing_id().alias("id"), "vec", F.col("shard").alias("part"))
    shards = reps.select("part").distinct()
    asked = points.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")).crossJoin(F.broadcast(shards))  # one row for each shard
    near = block_search(reps, asked, 1, metric).select(F.col("query_id").alias("id"), F.col("part").alias("shard"), "dist")
    free = near.join(cover, ["id", "shard"], "left_anti")
    return free.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("dist", "shard"))).where(F.col("r") <= keep).select("id", "shard", "dist")


def admit(ratings: DataFrame, cover: DataFrame, cap: int, extra: int) -> DataFrame:
    """(id, shard): ratings in global order of distance, each admitted while its shard has room, until extra are."""
    sizes = cover.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    placed = ratings.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("dist", "id"))).join(sizes, "shard", "left")
    fits = placed.where(F.col("place") + F.coalesce("n", F.lit(0)) <= cap)
    return fits.orderBy("dist", "id", "shard").limit(max(0, extra)).select("id", "shard")


def overlap_by_centers(points: DataFrame, cover: DataFrame, representatives: DataFrame, k: int, epsilon: float = 0.05, overlap: float = 0.2, metric: str = "l2") -> DataFrame:
    """cover with overlap * n replicas in the nearest foreign shards that have room; cap counts by the requested k."""
    n = points.count()
    cap, extra = max(1, int((1 + epsilon) * n / k)), int(overlap * n)
    if extra <= 0:
        return cover
    return cover.unionByName(admit(shard_ratings(points, representatives, cover, cap, metric=metric), cover, cap, extra))
