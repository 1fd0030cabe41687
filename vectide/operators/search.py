"""Search within shards: exact inverted lists, and hits on true neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import block_search, dedup_neighbours


def shard_points(points: DataFrame, assignment: DataFrame) -> DataFrame:
    """(id, vec, part): each shard's inverted list."""
    return points.join(assignment.distinct(), "id").select("id", "vec", F.col("shard").alias("part"))


def search_probes(points: DataFrame, assignment: DataFrame, queries: DataFrame, routes: DataFrame, k: int, probes: int | None = None, metric: str = "l2") -> DataFrame:
    """(shard, query_id, rank, neighbor_id, dist): the k nearest of each probed shard. Only probed shards are sent queries."""
    asked = routes if probes is None else routes.where(F.col("probe_rank") <= probes)
    asked = asked.select("query_id", "shard").distinct().join(queries, "query_id").select("query_id", "qvec", F.col("shard").alias("part"))
    return block_search(shard_points(points, assignment), asked, k, metric).withColumnRenamed("part", "shard")


def search_lists(points: DataFrame, assignment: DataFrame, queries: DataFrame, routes: DataFrame, k: int, probes: int, metric: str = "l2") -> DataFrame:
    """(query_id, rank, neighbor_id, dist): the k nearest over the first probes; a point in several lists counts once."""
    return dedup_neighbours(search_probes(points, assignment, queries, routes, k, probes, metric), k)


def search_shard(points: DataFrame, assignment: DataFrame, queries: DataFrame, shard: int, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, rank, neighbor_id, dist) in one shard; the filter reaches the assignment's scan."""
    own = assignment.where(F.col("shard") == shard)
    return block_search(shard_points(points, own), queries.withColumn("part", F.lit(shard)), k, metric).drop("part")


def true_hits(found: DataFrame, kth: DataFrame) -> DataFrame:
    """What is at most as far as the query's k-th true neighbour; filtered before anything is shuffled again."""
    return found.join(kth, "query_id").where(F.col("dist") <= F.col("kth")).drop("kth")
