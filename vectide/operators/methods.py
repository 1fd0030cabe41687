"""Partitioning methods by name."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from . import centroids
from .graphs import STRONG, Sketch, approximate_graph, symmetrise
from .neighbours import closest_leaders
from .overlap import overlap_by_centers, overlapping_graph_partition
from .partitioner import partition_graph
from .shards import last_ids, random_shards, up_to
from .trees import TreeOptions, train_trees

EPSILON = 0.05


def capacity(n: int, k: int, epsilon: float = EPSILON) -> int:
    return max(ceil(n / k), int((1 + epsilon) * n / k))


def neighbour_graph(points: DataFrame, degree: int = 10, strong: bool = False, metric: str = "l2") -> DataFrame:
    """The sketched kNN graph, written out as it is read many times; exact where all points are one bucket of the sketch."""
    return materialize(approximate_graph(points, degree, STRONG if strong else Sketch(), metric), "knn")


def _unit(points: DataFrame) -> DataFrame:
    return points.select("id", F.lit(1).cast("long").alias("weight"))


def graph_partition(points: DataFrame, k: int, metric: str = "l2", strong: bool = False) -> DataFrame:
    graph = materialize(symmetrise(neighbour_graph(points, 10, strong, metric)), "graph")
    return partition_graph(graph, _unit(points), k, EPSILON)


def pyramid(points: DataFrame, k: int, metric: str = "l2", sample: int = 10_000_000, aggregates: int = 10_000) -> DataFrame:
    """Aggregates of a sample are partitioned as a graph; points go to the shard of the nearest aggregate that has room.

    In each round shards take points by id up to their cap; the rest look on among the shards with room.
    """
    n = points.count()
    cap, m = capacity(n, k), max(k, min(aggregates, n // 4 or 1))
    picked = centroids.random_sample(points, min(sample, n), 555) if sample < n else points
    _, at = centroids.kmeans(picked, centroids.sample_vectors(picked, m), metric, 5)
    nodes = points.sparkSession.createDataFrame(pa.table({"id": pa.array(range(len(at)), pa.int64()), "vec": pa.array(list(at), pa.list_(pa.float64()))}))
    graph = materialize(symmetrise(neighbour_graph(nodes, min(10, len(at) - 1), metric=metric)), "graph")
    owner = materialize(partition_graph(graph, _unit(nodes), k, EPSILON), "aggregates")
    waiting, done, room = points.select("id", "vec"), None, {s: cap for s in range(k)}
    while True:
        free = [s for s, r in room.items() if r > 0]
        leaders = nodes.join(owner.where(F.col("shard").isin(free)), "id")
        near = closest_leaders(waiting, leaders.select("id", "vec"), 1, metric).join(owner.select(F.col("id").alias("leader"), "shard"), "leader")
        near = materialize(near.select("id", "shard"), "round")
        step = near.withColumn("in", up_to(last_ids(near, room)))
        placed = step.where("in").select("id", "shard")
        done = placed if done is None else done.unionByName(placed)
        got = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()
        for r in got:
            room[r["shard"]] -= r["n"]
        rest = step.where("not in").select("id")
        if rest.isEmpty():
            return done
        if not got:
            raise ValueError("ids repeat more often than a shard has room")
        waiting = materialize(points.select("id", "vec").join(rest, "id", "left_semi"), "waiting")
        owned = {r["shard"] for r in owner.select("shard").distinct().collect()}
        if not any(room[s] > 0 for s in owned):  # shards without an aggregate take what is left
            spare = [s for s in room if room[s] > 0]
            place = F.row_number().over(Window.orderBy("id")) - 1  # few: no more than the room of such shards
            return done.unionByName(rest.select("id", F.element_at(F.array(*[F.lit(s) for s in spare]), (place % len(spare) + 1).cast("int")).alias("shard")))


def leaf_pyramid(points: DataFrame, k: int, metric: str = "l2", ratio: float = 0.02) -> DataFrame:
    """Leaves of hierarchical k-means are nodes of their size; the partition of their 20-nearest graph is carried to the points."""
    ratio = min(0.5, max(ratio, 32 * k / max(1, points.count())))  # small leaves, as a leaf lies in one shard
    leaves, at = centroids.hierarchical_kmeans(points, ratio, metric=metric)
    leaves, at = materialize(leaves, "leaves"), materialize(at, "leaf-centers")
    nodes = at.select(F.col("leaf").cast("long").alias("id"), "vec")
    graph = materialize(symmetrise(neighbour_graph(nodes, 20, metric=metric)), "graph")
    of = partition_graph(graph, at.select(F.col("leaf").cast("long").alias("id"), F.col("size").alias("weight")), k, EPSILON)
    return leaves.join(of.select(F.col("id").cast("int").alias("leaf"), "shard"), "leaf").select("id", "shard")


def rebalanced_kmeans(points: DataFrame, k: int, metric: str = "l2", cap: int | None = None) -> DataFrame:
    """k-means into k clusters; what is over the cap, by default that of k shards, is evicted. A cap too small for the clusters left grows to fit."""
    assigned, at = centroids.kmeans(points, centroids.sample_vectors(points, k), metric)
    assigned, n = materialize(assigned.select("id", "shard"), "assigned"), points.count()
    return centroids.evict_overloaded(points, assigned, at, max(cap or capacity(n, k), ceil(n / len(at))), metric)


def _spann(points: DataFrame, base: DataFrame, k: int, overlap: float, metric: str) -> DataFrame:
    base = materialize(base, "base")
    shards = base.select("shard").distinct().count()
    trees = train_trees(points, base, TreeOptions(num_centroids=64, min_cluster_size=350, budget=64 * shards, rounds=5), metric)
    return overlap_by_centers(points, base, trees.select("shard", "vec"), k, EPSILON, overlap, metric)


def _grown(points: DataFrame, k: int, overlap: float) -> int:
    n = points.count()
    return ceil((n + int(overlap * n)) / capacity(n, k))


METHODS: dict[str, Callable[[DataFrame, int, float, str], DataFrame]] = {
    "Random": lambda p, k, o, m: random_shards(p, k),
    "GP": lambda p, k, o, m: METHODS["OGP"](p, k, o, m) if o else graph_partition(p, k, m),
    "StrongGP": lambda p, k, o, m: graph_partition(p, k, m, strong=True),
    "Pyramid": lambda p, k, o, m: pyramid(p, k, m),
    "OurPyramid": lambda p, k, o, m: leaf_pyramid(p, k, m),
    "KMeans": lambda p, k, o, m: centroids.recursive_kmeans(p, k, capacity(p.count(), k), m),
    "BalancedKMeans": lambda p, k, o, m: centroids.balanced_kmeans(p, k, capacity(p.count(), k), m),
    "FlatKMeans": lambda p, k, o, m: centroids.flat_kmeans(p, k, m),
    "RKM": lambda p, k, o, m: rebalanced_kmeans(p, k, m),
    "ORKM": lambda p, k, o, m: _spann(p, rebalanced_kmeans(p, ceil(k * (1 + o)), m, capacity(p.count(), k)), k, o, m),  # more shards, each with the room of one of k
    "OGP": lambda p, k, o, m: overlapping_graph_partition(neighbour_graph(p, metric=m), p, k, EPSILON, o),
    "OGPS": lambda p, k, o, m: _spann(p, graph_partition(p, _grown(p, k, o), m), k, o, m),
    "OKM": lambda p, k, o, m: _spann(p, centroids.recursive_kmeans(p, k, capacity(p.count(), k), m), k, o, m),
    "OBKM": lambda p, k, o, m: _spann(p, centroids.balanced_kmeans(p, ceil(k * (1 + o)), capacity(p.count(), ceil(k * (1 + o))), m), k, o, m),
}


def partition(points: DataFrame, method: str, k: int, overlap: float = 0.0, metric: str = "l2") -> DataFrame:
    """(id, shard) of points(id, vec) by a method's name."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    return METHODS[method](points, k, overlap, metric)
