"""Recall by distance, by shards probed, and its upper bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distance_recall(found: DataFrame, kth: DataFrame, k: int, n_queries: int) -> DataFrame:
    """(recall): results(query_id, dist) at most as far as the k-th true neighbour, ties included, over k for each query."""
    hits = found.join(kth, "query_id").agg(F.count_if(F.col("dist") <= F.col("kth")).alias("hits"))
    return hits.select((F.col("hits") / F.lit(float(n_queries * k))).alias("recall"))


def graph_recall(approximate: DataFrame, exact: DataFrame, n_points: int, k: int) -> DataFrame:
    """(recall): edges of the approximate graph that the exact one has, over n * k."""
    both = approximate.select("src", "dst").join(exact.select("src", "dst"), ["src", "dst"], "left_semi")
    return both.agg((F.count(F.lit(1)) / F.lit(float(n_points * k))).alias("recall"))


def neighbour_shards(truth: DataFrame, assignment: DataFrame) -> DataFrame:
    """(query_id, neighbor_id, shard): the shards that hold each true neighbour."""
    return truth.join(assignment, F.col("neighbor_id") == F.col("id")).select("query_id", "neighbor_id", "shard")


def first_shard_recall(truth: DataFrame, assignment: DataFrame, k: int) -> DataFrame:
    """(recall): if each query probed the one shard that holds most of its neighbours."""
    per = neighbour_shards(truth, assignment).groupBy("query_id", "shard").agg(F.count(F.lit(1)).alias("c")).groupBy("query_id").agg(F.max("c").alias("c"))
    queries = truth.select("query_id").distinct().agg(F.count(F.lit(1)).alias("nq"))
    return per.agg(F.sum("c").alias("c")).crossJoin(queries).select((F.coalesce("c", F.lit(0)) / (F.col("nq") * F.lit(float(k)))).alias("recall"))


def first_probe(routes: DataFrame, hits: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(extra..., query_id, neighbor_id, p): the first probe whose shard returns the neighbour. hits: (query_id, shard, neighbor_id)."""
    keys = [*(extra or []), "query_id", "neighbor_id"]
    return routes.join(hits, ["query_id", "shard"]).groupBy(*keys).agg(F.min("probe_rank").alias("p"))


def recall_by_probes(routes: DataFrame, hits: DataFrame, shards: int, k: int, n_queries: int, extra: list[str] | None = None) -> DataFrame:
    """(extra..., probes, recall) for 1 to shards probes: distinct hits so far, at most k for each query, over all queries * k."""
    extra = extra or []
    new = first_probe(routes, hits, extra).groupBy(*extra, "query_id", "p").agg(F.count(F.lit(1)).alias("c"))
    # the gain of each query at each probe, at most k in all
    w = Window.partitionBy(*extra, "query_id").orderBy("p")
    gained = new.withColumn("so_far", F.least(F.lit(k), F.sum("c").over(w)))
    gained = gained.withColumn("gain", F.col("so_far") - F.coalesce(F.lag("so_far").over(w), F.lit(0)))
    per = gained.groupBy(*extra, "p").agg(F.sum("gain").alias("gain"))
    probes = F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("p")
    every = routes.select(*extra).distinct().select(*extra, probes) if extra else routes.sparkSession.range(1).select(probes)
    total = F.sum(F.coalesce("gain", F.lit(0))).over(Window.partitionBy(*(extra or [F.lit(0)])).orderBy("p"))  # one row for each probe
    return every.join(per, [*extra, "p"], "left").select(*extra, F.col("p").cast("int").alias("probes"), (total / F.lit(float(n_queries * k))).alias("recall"))


def oracle_routes(truth: DataFrame, assignment: DataFrame) -> DataFrame:
    """(query_id, probe_rank, shard, freq): shards by how many true neighbours they hold."""
    per = neighbour_shards(truth, assignment).groupBy("query_id", "shard").agg(F.count(F.lit(1)).alias("freq"))
    w = Window.partitionBy("query_id").orderBy(F.desc("freq"), "shard")
    return per.select("query_id", F.row_number().over(w).alias("probe_rank"), "shard", "freq")


def disjoint_oracle_recall(truth: DataFrame, assignment: DataFrame, k: int) -> DataFrame:
    """(probes, recall) if each query probes shards by how many of its neighbours they hold, where no two shards share points.

    Ends with the last probe that finds something.
    """
    gains = oracle_routes(truth, assignment).groupBy("probe_rank").agg(F.sum("freq").alias("gain"))
    queries = truth.select("query_id").distinct().agg(F.count(F.lit(1)).alias("nq"))
    so_far = F.sum("gain").over(Window.orderBy("probe_rank"))  # one row for each probe
    return gains.select("probe_rank", so_far.alias("c")).crossJoin(queries).select(F.col("probe_rank").cast("int").alias("probes"), (F.col("c") / (F.col("nq") * F.lit(float(k)))).alias("recall"))


def max_first_route_recall(routes: DataFrame, truth: DataFrame, assignment: DataFrame, k: int) -> DataFrame:
    """(route_id, recall): of each route's first shard, if the search in it is exact."""
    first = routes.where(F.col("probe_rank") == 1).join(neighbour_shards(truth, assignment), ["query_id", "shard"], "left")
    return first.groupBy("route_id").agg((F.count("neighbor_id") / (F.count_distinct("query_id") * F.lit(float(k)))).alias("recall"))


def best_route(recalls: DataFrame) -> DataFrame:
    """The row of the best recall, the smallest route_id at a tie."""
    return recalls.orderBy(F.desc("recall"), "route_id").limit(1)


def max_search_recall(hits: DataFrame, k: int, n_queries: int) -> DataFrame:
    """(ef, recall): distinct hits over all shards, at most k for each query."""
    per = hits.groupBy("ef", "query_id").agg(F.least(F.lit(k), F.count_distinct("neighbor_id")).alias("c"))
    return per.groupBy("ef").agg((F.sum("c") / F.lit(float(n_queries * k))).alias("recall"))
