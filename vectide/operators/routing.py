"""Routers: which shards a query probes, and in which order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import block_search, closest_leaders


def by_distance(reached: DataFrame, shards: DataFrame | None = None) -> DataFrame:
    """(query_id, probe_rank, shard): all shards by min_dist; with shards given, those not reached come last, by id."""
    if shards is not None:
        every = reached.select("query_id").distinct().crossJoin(F.broadcast(shards.select("shard").distinct()))
        reached = every.join(reached, ["query_id", "shard"], "left")
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("min_dist"), "shard")
    return reached.select("query_id", F.row_number().over(w).alias("probe_rank"), "shard")


def nearest_in_shards(points: DataFrame, assignment: DataFrame, queries: DataFrame, metric: str = "l2") -> DataFrame:
    """(query_id, shard, min_dist) over all points of each shard."""
    parts = assignment.select(F.col("shard").alias("part")).distinct()
    own = points.join(assignment, "id").select("id", "vec", F.col("shard").alias("part"))
    found = block_search(own, queries.crossJoin(F.broadcast(parts)), 1, metric)
    return found.select("query_id", F.col("part").alias("shard"), F.col("dist").alias("min_dist"))


def brute_force(points: DataFrame, assignment: DataFrame, queries: DataFrame, metric: str = "l2") -> DataFrame:
    return by_distance(nearest_in_shards(points, assignment, queries, metric))


def from_truth(truth: DataFrame, assignment: DataFrame) -> DataFrame:
    """(query_id, shard, min_dist) of the shards that hold true neighbours."""
    return truth.join(assignment, F.col("neighbor_id") == F.col("id")).groupBy("query_id", "shard").agg(F.min("dist").alias("min_dist"))


def uncovered(reached: DataFrame, shards: int) -> DataFrame:
    """(uncovered): how many queries reach fewer than all shards."""
    return reached.groupBy("query_id").agg(F.count("shard").alias("n")).agg(F.count_if(F.col("n") < shards).alias("uncovered"))


def votes(routing_points: DataFrame, queries: DataFrame, n_votes: int, metric: str = "l2") -> DataFrame:
    """(query_id, shard, min_dist, votes): of the nearest n_votes routing points(id, vec, shard), by shard."""
    near = closest_leaders(queries.select(F.col("query_id").alias("id"), F.col("qvec").alias("vec")), routing_points.select("id", "vec"), n_votes, metric)
    of = routing_points.select(F.col("id").alias("leader"), "shard")
    return near.join(of, "leader").groupBy(F.col("id").alias("query_id"), "shard").agg(F.min("dist").alias("min_dist"), F.count(F.lit(1)).alias("votes"))


def frequency(voted: DataFrame, shards: DataFrame | None = None) -> DataFrame:
    """The shard with most votes first, the smallest id at a tie; the others by min_dist."""
    if shards is not None:
        every = voted.select("query_id").distinct().crossJoin(F.broadcast(shards.select("shard").distinct()))
        voted = every.join(voted, ["query_id", "shard"], "left")
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("votes"), "shard")) == 1
    w = Window.partitionBy("query_id").orderBy(F.desc("top"), F.asc_nulls_last("min_dist"), "shard")
    return voted.withColumn("top", top).select("query_id", F.row_number().over(w).alias("probe_rank"), "shard")


def _by_shard(kept: DataFrame) -> DataFrame:
    return kept.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("shard")).alias("probe_rank"), "shard")


def pyramid(voted: DataFrame) -> DataFrame:
    """The shards that are reached, by id."""
    return _by_shard(voted.where(F.col("min_dist").isNotNull()))


def spann(voted: DataFrame, eps: float = 0.6) -> DataFrame:
    """The shards within (1 + eps) times the closest distance, by id; the closest one in any case, as distances may be negative."""
    q = Window.partitionBy("query_id")
    best = F.row_number().over(q.orderBy(F.asc_nulls_last("min_dist"), "shard")) == 1
    near = F.col("min_dist") <= (1 + eps) * F.min("min_dist").over(q)
    return _by_shard(voted.withColumns({"best": best, "near": near}).where(F.col("best") | F.col("near")))


def single_center(centers: DataFrame, queries: DataFrame, metric: str = "l2") -> DataFrame:
    """(query_id, shard, min_dist) by one center(shard, vec) for each shard."""
    points = centers.select(F.col("shard").cast("long").alias("id"), "vec")
    near = closest_leaders(queries.select(F.col("query_id").alias("id"), F.col("qvec").alias("vec")), points, 2**31 - 1, metric)
    return near.select(F.col("id").alias("query_id"), F.col("leader").cast("int").alias("shard"), F.col("dist").alias("min_dist"))


def router_configs(n_points: int, budgets: tuple[int, ...] = (20_000, 100_000, 200_000, 500_000, 1_000_000, 2_000_000, 5_000_000, 10_000_000)) -> list[dict]:
    """Budgets with 64 centroids a node, and for the largest budgets with 128 too."""
    out = []
    for b in budgets:
        for centroids in (64, 128) if b >= 5_000_000 else (64,):
            out.append({"route_config": len(out), "budget": b, "num_centroids": centroids, "min_cluster_size": 350, "share": min(1.0, b / max(1, n_points))})
    return out


VOTE_COUNTS = (20, 40, 80, 120, 200, 250, 300, 400, 500)


def vote_sweep(routing_points: DataFrame, queries: DataFrame, shards: DataFrame, counts: tuple[int, ...] = VOTE_COUNTS, metric: str = "l2") -> DataFrame:
    """(route_id, algorithm, votes, query_id, probe_rank, shard) for each count and each of four rules, from one search for the largest count."""
    near = closest_leaders(queries.select(F.col("query_id").alias("id"), F.col("qvec").alias("vec")), routing_points.select("id", "vec"), max(counts), metric)
    ranked = near.join(routing_points.select(F.col("id").alias("leader"), "shard"), "leader").select(F.col("id").alias("query_id"), "shard", "rank", "dist").persist()
    rules: list[tuple[str, Callable[[DataFrame], DataFrame]]] = [("nearest", lambda v: by_distance(v, shards)), ("pyramid", pyramid), ("spann", spann), ("frequency", lambda v: frequency(v, shards))]
    out, route = None, 0
    for n in counts:
        voted = ranked.where(F.col("rank") <= n).groupBy("query_id", "shard").agg(F.min("dist").alias("min_dist"), F.count(F.lit(1)).alias("votes"))
        for name, rule in rules:
            one = rule(voted).select(F.lit(route).alias("route_id"), F.lit(name).alias("algorithm"), F.lit(n).alias("votes"), "query_id", "probe_rank", "shard")
            out, route = (one if out is None else out.unionByName(one)), route + 1
    return out
