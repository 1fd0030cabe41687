"""Whole experiments: query attribution, search by probes, loss analysis, graph quality, partition sweeps."""

from __future__ import annotations

import time
from collections.abc import Iterable
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution, centroids, graphs, methods, neighbours, recall, routing, search, shards, trees
from ..sources.shared import materialize


def route_set(points: DataFrame, assignment: DataFrame, queries: DataFrame, how: trees.TreeOptions, vote_counts: tuple[int, ...] = routing.VOTE_COUNTS, metric: str = "l2") -> DataFrame:
    """(route_id, algorithm, votes, increasing, query_id, probe_rank, shard): tree search, voting tree search, the vote sweep over all centroids, random order.

    Pyramid and SPANN lists differ in length; they aren't increasing.
    """
    every = assignment.select("shard").distinct()
    built = materialize(trees.train_trees(points, assignment, how, metric), "trees")
    found = [("tree", 0, routing.by_distance(trees.query_trees(built, queries, how, metric), every))]
    found += [("tree-frequency", n, routing.frequency(trees.query_trees(built, queries, how, metric, votes=n), every)) for n in vote_counts]
    found += [("random", 0, shards.random_routes(queries, every))]
    out = None
    for k, (name, n, routes) in enumerate(found):
        one = routes.select(F.lit(k).alias("route_id"), F.lit(name).alias("algorithm"), F.lit(n).alias("votes"), F.lit(True).alias("increasing"), "query_id", "probe_rank", "shard")
        out = one if out is None else out.unionByName(one)
    sweep = routing.vote_sweep(trees.routing_points(built), queries, every, vote_counts, metric)
    return out.unionByName(sweep.withColumn("route_id", F.col("route_id") + len(found)).withColumn("increasing", ~F.col("algorithm").isin("pyramid", "spann")))


def all_route_sets(points: DataFrame, assignment: DataFrame, queries: DataFrame, configs: Iterable[dict] | None = None, vote_counts: tuple[int, ...] = routing.VOTE_COUNTS, metric: str = "l2") -> DataFrame:
    """route_set of each of the router configs, with route_config; route numbers run on, and random order is there once."""
    out, first = None, 0
    for c in routing.router_configs(points.count()) if configs is None else configs:
        how = trees.TreeOptions(num_centroids=c["num_centroids"], min_cluster_size=c["min_cluster_size"], budget=c["budget"])
        one = route_set(points, assignment, queries, how, vote_counts, metric)
        one = one if out is None else one.where(F.col("algorithm") != "random")
        one = one.select(F.lit(c["route_config"]).alias("route_config"), (F.col("route_id") + first).alias("route_id"), "algorithm", "votes", "increasing", "query_id", "probe_rank", "shard")
        out, first = (one if out is None else out.unionByName(one)), first + 2 + 5 * len(vote_counts)
    return out


def ef_sweep(points: DataFrame, queries: DataFrame, k: int, efs: tuple[int, ...] = (20, 50, 80, 100, 120, 150, 200, 300, 400), how: trees.GraphOptions | None = None, repeats: int = 1, metric: str = "l2") -> DataFrame:
    """(ef, recall, seconds) of graph search without shards; seconds a query, the median of so many runs; (ef, recall) without runs."""
    one, n = F.lit(0).alias("part"), queries.count()
    asked = queries.select("query_id", "qvec", one)
    index = materialize(trees.graph_index(points.select("id", "vec", one), how, metric), "index")
    kth = neighbours.kth_distance(neighbours.ground_truth(points, queries, k, metric), k)
    hits = search.true_hits(trees.search_index(index, asked, k, list(efs), metric), kth).groupBy("ef").agg(F.count(F.lit(1)).alias("c"))
    every = points.sparkSession.createDataFrame([(e,) for e in efs], "ef int")
    swept = every.join(hits, "ef", "left").select("ef", (F.coalesce("c", F.lit(0)) / F.lit(float(n * k))).alias("recall"))
    return swept.join(trees.search_times(index, asked, k, list(efs), repeats, metric).drop("part"), "ef") if repeats else swept


def small_scale(points: DataFrame, assignment: DataFrame, queries: DataFrame, k: int, how: trees.TreeOptions | None = None, graph: trees.GraphOptions | None = None, ef: int = 120, votes: int = 60, metric: str = "l2") -> DataFrame:
    """(routing, shard_query, probes, recall, routing_seconds): two routers, two searches in shards, all numbers of probes.

    Routing by k-means trees, or by votes of the nearest centroids of these trees found in a graph; search by all points of a shard or in
    its graph. routing_seconds is the wall time of a router's job.
    """
    how = how or trees.TreeOptions(num_centroids=32, min_cluster_size=200, budget=50_000, search_budget=5_000)
    graph = graph or trees.GraphOptions(m=16, ef_search=200)
    n_queries, every = queries.count(), materialize(assignment.select("shard").distinct(), "every")
    n_shards = every.count()
    kth = materialize(neighbours.kth_distance(neighbours.ground_truth(points, queries, k, metric), k), "kth")
    built = materialize(trees.train_trees(points, assignment, how, metric), "trees")
    centroid = trees.routing_points(built)
    near = trees.graph_search_all(centroid.select("id", "vec"), queries, votes, graph.ef_search, graph, metric)
    voted = near.join(centroid.select(F.col("id").alias("neighbor_id"), "shard"), "neighbor_id").groupBy("query_id", "shard").agg(F.min("dist").alias("min_dist"))
    routers = {"tree": routing.by_distance(trees.query_trees(built, queries, how, metric), every), "graph": routing.by_distance(voted, every)}
    hits = {"all points": shard_hits(points, assignment, queries, kth, k, metric=metric), "graph": shard_hits(points, assignment, queries, kth, k, [ef], metric)}
    hits = {name: materialize(own, "hits") for name, own in hits.items()}
    out = None
    for router, routes in routers.items():
        began = time.perf_counter()
        routes = materialize(routes, "routes")
        took = time.perf_counter() - began
        for name, own in hits.items():
            one = recall.recall_by_probes(routes, own.drop("ef"), n_shards, k, n_queries)
            one = one.select(F.lit(router).alias("routing"), F.lit(name).alias("shard_query"), "probes", "recall", F.lit(took).alias("routing_seconds"))
            out = one if out is None else out.unionByName(one)
    return out


def shard_hits(points: DataFrame, assignment: DataFrame, queries: DataFrame, kth: DataFrame, k: int, efs: list[int] | None = None, metric: str = "l2") -> DataFrame:
    """(ef, shard, query_id, neighbor_id): true neighbours that each shard returns, by graph search for each beam width, or exactly (ef 0)."""
    every = assignment.select("shard").distinct()
    asked = queries.crossJoin(F.broadcast(every))  # one row for each shard
    if efs:
        found = trees.graph_search(search.shard_points(points, assignment), asked.withColumnRenamed("shard", "part"), k, efs, metric=metric).withColumnRenamed("part", "shard")
    else:
        found = search.search_probes(points, assignment, queries, asked.select("query_id", "shard").withColumn("probe_rank", F.lit(1)), k, metric=metric).withColumn("ef", F.lit(0))
    return search.true_hits(found, kth).select("ef", "shard", "query_id", "neighbor_id")


def _shard_seconds(points: DataFrame, assignment: DataFrame, queries: DataFrame, k: int, efs: list[int], metric: str) -> DataFrame:
    """(ef, shard, cost): seconds of a query in each shard."""
    index = materialize(trees.graph_index(search.shard_points(points, assignment), metric=metric), "index")
    asked = queries.crossJoin(assignment.select(F.col("shard").alias("part")).distinct())  # every query is timed in every shard
    took = materialize(trees.search_times(index, asked, k, efs, metric=metric), "times")
    return took.select("ef", F.col("part").alias("shard"), F.col("seconds").alias("cost"))


def query_attribution(points: DataFrame, assignment: DataFrame, queries: DataFrame, k: int, how: trees.TreeOptions, efs: list[int] | None = None, vote_counts: tuple[int, ...] = (20, 100), extra_hosts: int = 20, metric: str = "l2", timed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table, front) over all routes and searches: (route_id, ef, probes, recall, hosts, latency, qps, ...), and what no other row beats.

    Latency is in points scanned, or if timed in seconds of graph search: the median of five runs in each shard for each of efs. Routes,
    hits and costs are computed once and joined.
    """
    n_queries, n_shards = queries.count(), assignment.select("shard").distinct().count()
    kth = materialize(neighbours.kth_distance(neighbours.ground_truth(points, queries, k, metric), k), "kth")
    routes = materialize(route_set(points, assignment, queries, how, vote_counts, metric), "routes")
    hits = materialize(shard_hits(points, assignment, queries, kth, k, efs, metric), "hits")
    if timed and not efs:
        raise ValueError("only graph search is timed; give efs")
    cost = _shard_seconds(points, assignment, queries, k, efs, metric) if timed else shards.shard_sizes(assignment).withColumnRenamed("size", "cost")
    searches = hits.select("ef").distinct()
    both = routes.crossJoin(F.broadcast(searches))  # one row for each beam width
    keys = ["route_id", "ef"]
    grown = attribution.work_by_probes(both.where("increasing"), cost, n_shards, keys)
    firsts = recall_rows(both.where("increasing"), hits, n_shards, k, n_queries, keys)
    hosts = attribution.replica_latency(grown, extra_hosts, [*keys, "probes"])
    increasing = hosts.join(firsts.withColumn("probes", F.col("probes").cast("long")), [*keys, "probes"]).withColumn("probes", F.col("probes").cast("double"))
    fixed = both.where("not increasing")
    whole = fixed.join(cost, [c for c in cost.columns if c != "cost"]).groupBy(*keys, "shard").agg(F.sum("cost").alias("work"))
    once = variable_rows(fixed, hits, k, n_queries, keys)
    variable = attribution.replica_latency(whole, extra_hosts, keys).join(once, keys)
    table = attribution.throughput(increasing.unionByName(variable.select(increasing.columns)), n_queries)
    return table, attribution.pareto_front(table)


def recall_rows(routes: DataFrame, hits: DataFrame, n_shards: int, k: int, n_queries: int, keys: list[str]) -> DataFrame:
    """Recall by probes where routes and hits belong to a beam width, ef."""
    own = routes.join(hits, ["query_id", "shard", "ef"]).select(*keys, "query_id", "probe_rank", "neighbor_id")
    new = own.groupBy(*keys, "query_id", "neighbor_id").agg(F.min("probe_rank").alias("p")).groupBy(*keys, "query_id", "p").agg(F.count(F.lit(1)).alias("c"))
    later = new.select(*keys, "query_id", "c", F.explode(F.sequence(F.col("p"), F.lit(n_shards))).alias("probes"))
    per = later.groupBy(*keys, "query_id", "probes").agg(F.least(F.lit(k), F.sum("c")).alias("c"))
    return per.groupBy(*keys, "probes").agg((F.sum("c") / F.lit(float(n_queries * k))).alias("recall"))


def variable_rows(routes: DataFrame, hits: DataFrame, k: int, n_queries: int, keys: list[str]) -> DataFrame:
    own = routes.join(hits, ["query_id", "shard", "ef"]).select(*keys, "query_id", "neighbor_id")
    per = own.groupBy(*keys, "query_id").agg(F.least(F.lit(k), F.count_distinct("neighbor_id")).alias("c")).groupBy(*keys).agg(F.sum("c").alias("c"))
    lengths = routes.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(float(n_queries))).alias("probes"))
    return lengths.join(per, keys, "left").select(*keys, "probes", (F.coalesce("c", F.lit(0)) / F.lit(float(n_queries * k))).alias("recall"))


def loss_analysis(points: DataFrame, assignment: DataFrame, queries: DataFrame, k: int, sample: int = 1000, metric: str = "l2") -> DataFrame:
    """(router, probes, recall): by one center a shard, by all points, by the ground truth, by a tree's centroids, by a uniform sample."""
    n_shards, n_queries = assignment.select("shard").distinct().count(), queries.count()
    truth = materialize(neighbours.ground_truth(points, queries, k, metric), "truth")
    hits = materialize(recall.neighbour_shards(truth, assignment), "hits")
    every = assignment.select("shard").distinct()
    how = trees.TreeOptions(budget=sample, search_budget=2**31 - 1, rounds=5)
    picked = shards.random_sample(points, sample, 420).join(assignment, "id")
    routers = {
        "single center": routing.by_distance(routing.single_center(centroids.centers(points, assignment, metric), queries, metric)),
        "all points": routing.brute_force(points, assignment, queries, metric),
        "ground truth": routing.by_distance(routing.from_truth(truth, assignment), every),
        "tree": routing.by_distance(trees.query_trees(trees.train_trees(points, assignment, how, metric), queries, how, metric), every),
        "uniform sample": routing.by_distance(routing.nearest_in_shards(picked.select("id", "vec"), picked.select("id", "shard"), queries, metric), every),
        "oracle": recall.oracle_routes(truth, assignment).drop("freq"),
    }
    out = None
    for name, routes in routers.items():
        one = recall.recall_by_probes(routes, hits, n_shards, k, n_queries).withColumn("router", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("router", "probes", "recall")


def graph_quality(points: DataFrame, queries: DataFrame, k: int, n_shards: int, grid: Iterable[tuple[int, int, int]] = tuple(product((1, 2, 3, 5, 10), (1, 2, 3, 5, 10), (500, 1000, 2000, 5000, 10_000))), degrees: tuple[int, ...] = (2, 4, 6, 8, 10, 20, 50, 100), metric: str = "l2") -> list[dict]:
    """For each (repetitions, fanout, bucket) and degree, and for the exact graph: recall of the graph, and of the first shard of its partition."""
    truth, n = materialize(neighbours.ground_truth(points, queries, k, metric), "truth"), points.count()
    most = max(degrees)
    exact = materialize(neighbours.exact_graph(points, most, metric), "exact")
    unit = points.select("id", F.lit(1).cast("long").alias("weight"))
    out = []
    for how in [None, *grid]:
        began = time.perf_counter()
        graph = exact if how is None else materialize(graphs.approximate_graph(points, most, graphs.Sketch(repetitions=how[0], fanout=how[1], bucket=how[2]), metric), "graph")
        took = time.perf_counter() - began
        for degree in degrees:
            cut = graphs.cut_degree(graph, degree)
            shard = materialize(methods.partition_graph(graphs.symmetrise(cut), unit, n_shards), "shards")
            out.append({"builder": "exact" if how is None else "sketch {}x{}/{}".format(*how), "degree": degree, "seconds": took, "graph_recall": recall.graph_recall(cut, graphs.cut_degree(exact, k), n, k).first()[0], "first_shard_recall": recall.first_shard_recall(truth, shard, k).first()[0]})
    return out


def partition_sweep(points: DataFrame, names: Iterable[str], ks: Iterable[int], overlaps: Iterable[float] = (0.0,), metric: str = "l2") -> list[dict]:
    """Seconds, replicas and balance of each method, number of shards and overlap."""
    out, n = [], points.count()
    for name, k, o in product(names, ks, overlaps):
        began = time.perf_counter()
        made = materialize(methods.partition(points, name, k, o, metric), "partition")
        took = time.perf_counter() - began
        sizes = shards.imbalance(made, k).first()
        out.append({"method": name, "k": k, "overlap": o, "seconds": took, "replicas": made.count() - n, "max_size": sizes["max_size"], "imbalance": sizes["imbalance"]})
    return out
