"""Hand-made fixtures and invariants."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import attribution, centroids, graphs, kernels, lloyd, methods, neighbours, overlap, partitioner, recall, routing, search, shards, trees


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0])], "id long, vec array<double>")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(240, 8)) + np.repeat(rng.normal(size=(6, 8)) * 4, 40, axis=0)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(240), "vec": [x.tolist() for x in v]})).persist(), v


def test_ties_go_to_the_smaller_id(grid):
    asked = grid.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    found = neighbours.ground_truth(grid, asked.where("query_id = 0"), 10)
    assert rows(found, "rank", "neighbor_id", "dist") == [(1, 0, 0.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 2.0)]
    graph = neighbours.exact_graph(grid, 1)
    assert rows(graph, "src", "dst") == [(0, 1), (1, 0), (2, 0), (3, 1)]


def test_zero_vector_is_left_alone(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [3.0, 0.0, 4.0])], "id long, vec array<double>")
    out = df.select("id", V.can_normalise(F.col("vec")).alias("ok"), V.normalise(F.col("vec")).alias("u"))
    assert rows(out, "id", "ok", "u") == [(0, False, [0.0, 0.0, 0.0]), (1, True, [0.6, 0.0, 0.8])]
    assert V.norm_audit(df).first().asDict() == {"n": 2, "unit_before": 0, "unit_after": 1}


def test_unknown_metric(grid):
    with pytest.raises(ValueError):
        neighbours.exact_graph(grid, 1, "cosine")


def test_copies_are_one_cluster(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "id long, vec array<double>")
    assigned, at = centroids.kmeans(df, np.array([[1.0, 2.0]] * 3), rounds=3)
    assert {r["shard"] for r in assigned.collect()} == {0} and len(at) == 1


def test_gaps_in_ids(spark):
    df = spark.createDataFrame([(0, 5), (1, 0), (2, 2)], "id long, shard int")
    once = shards.compact_ids(df)
    assert rows(once, "id", "shard") == [(0, 2), (1, 0), (2, 1)]
    assert rows(shards.compact_ids(once), "id", "shard") == rows(once, "id", "shard")
    assert shards.num_parts(df.where("false")).first()[0] == 0


def test_hits_in_two_shards_count_once(spark):
    routes = spark.createDataFrame([(0, 1, 0), (0, 2, 1)], "query_id long, probe_rank int, shard int")
    hits = spark.createDataFrame([(0, 0, 3), (0, 1, 3), (0, 1, 4)], "query_id long, shard int, neighbor_id long")
    assert rows(recall.recall_by_probes(routes, hits, 3, 2, 1), "probes", "recall") == [(1, 0.5), (2, 1.0), (3, 1.0)]
    assert attribution.variable(routes, hits, 2, 1).first().asDict() == {"probes": 2.0, "recall": 1.0}


def test_spann_keeps_the_closest_shard_under_negative_distances(spark):
    voted = spark.createDataFrame([(0, 0, -2.0, 1), (0, 1, -0.5, 1)], "query_id long, shard int, min_dist double, votes int")
    assert rows(routing.spann(voted), "shard") == [(0,)]


def test_unreached_shards_come_last(spark):
    voted = spark.createDataFrame([(0, 2, 1.0, 1)], "query_id long, shard int, min_dist double, votes int")
    every = spark.createDataFrame([(0,), (1,), (2,)], "shard int")
    assert rows(routing.by_distance(voted.drop("votes"), every), "probe_rank", "shard") == [(1, 2), (2, 0), (3, 1)]
    assert rows(routing.frequency(voted, every), "probe_rank", "shard") == [(1, 2), (2, 0), (3, 1)]


def serial(points, home, at, cap):
    """Evictions one by one."""
    by = {}
    for i in sorted(home):
        by.setdefault(home[i], []).append(i)
    out = {i: s for s, ids in by.items() for i in ids[:cap]}
    room = [cap - sum(s == c for s in out.values()) for c in range(len(at))]
    for s in sorted(by):
        for i in sorted(by[s][cap:], reverse=True):
            d = [((np.asarray(points[i]) - c) ** 2).sum() if room[k] > 0 else np.inf for k, c in enumerate(at)]
            c = int(np.argmin(d))
            room[c] -= 1
            out[i] = c
    return out


def test_overload_evicts_the_highest_ids(spark):
    points = {i: [float(i), 0.0] for i in range(8)}
    home = {**{i: 0 for i in range(6)}, 6: 1, 7: 2}
    df = spark.createDataFrame(list(points.items()), "id long, vec array<double>")
    at = np.array([[2.0, 0.0], [6.0, 0.0], [7.0, 0.0]])
    out = centroids.evict_overloaded(df, spark.createDataFrame(list(home.items()), "id long, shard int"), at, 3)
    assert dict(rows(out, "id", "shard")) == serial(points, home, at, 3)
    with pytest.raises(ValueError):
        centroids.evict_overloaded(df, spark.createDataFrame(list(home.items()), "id long, shard int"), at, 2)


def test_evictions_as_one_by_one(spark):
    rng = np.random.default_rng(3)
    points = {i: rng.normal(size=3).tolist() for i in range(60)}
    home = {i: int(rng.choice(5, p=[0.5, 0.3, 0.1, 0.05, 0.05])) for i in range(60)}
    at = rng.normal(size=(5, 3))
    out = centroids.evict_overloaded(spark.createDataFrame(list(points.items()), "id long, vec array<double>"), spark.createDataFrame(list(home.items()), "id long, shard int"), at, 13)
    assert dict(rows(out, "id", "shard")) == serial(points, home, at, 13)


def test_symmetry_and_weights(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (0, 2)], "src long, dst long")
    assert rows(graphs.symmetrise(edges), "src", "dst", "weight") == [(0, 1, 2), (0, 2, 1), (1, 0, 2), (2, 0, 1)]


def test_replicas(spark):
    work = spark.createDataFrame([(0, 6), (1, 3), (2, 1)], "shard int, work long")
    assert rows(attribution.replica_latency(work, 3), "hosts", "latency") == [(3, 6.0), (4, 3.0), (5, 3.0), (6, 2.0)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 50), min_size=1, max_size=6), st.integers(0, 8))
def test_replicas_as_greedy(spark, work, more):
    hosts, want = [1] * len(work), []
    for t in range(more + 1):
        load = [w / h for w, h in zip(work, hosts, strict=True)]
        want.append((len(work) + t, max(load)))
        hosts[load.index(max(load))] += 1
    df = spark.createDataFrame(list(enumerate(work)), "shard int, work long")
    assert rows(attribution.replica_latency(df, more), "hosts", "latency") == want


def test_front(spark):
    df = spark.createDataFrame([(0.5, 10.0), (0.6, 9.0), (0.6, 9.0), (0.4, 9.0)], "recall double, qps double")
    assert rows(attribution.pareto_front(df), "recall", "qps") == [(0.5, 10.0), (0.6, 9.0)]


def test_random_shards_are_even(spark):
    out = shards.random_shards(spark.range(1003), 7)
    assert {r["size"] for r in shards.shard_sizes(out).collect()} <= {143, 144} and out.count() == 1003
    assert rows(out.repartition(9), "id", "shard") == rows(shards.random_shards(spark.range(1003).repartition(5), 7), "id", "shard")


def test_sample_is_clamped_and_stable(spark):
    assert shards.random_sample(spark.range(5), 10, 1).count() == 5
    assert rows(shards.random_sample(spark.range(100), 10, 1), "id") == rows(shards.random_sample(spark.range(100).repartition(7), 10, 1), "id")


def test_top_k_kernel_as_brute_force():
    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(size=(40, 5)), 2, axis=0)
    ids = np.arange(80)[::-1].copy()
    for metric in ("l2", "mips"):
        q, i, d = kernels.top_k(ids, v, np.arange(4), v[:4] + 0.1, 7, metric)
        for k in range(4):
            exact = kernels.distances(v, v[k] + 0.1, metric)
            assert i[q == k].tolist() == ids[np.lexsort((ids, exact))[:7]].tolist()


@pytest.mark.parametrize("method", ["Random", "GP", "Pyramid", "OurPyramid", "KMeans", "BalancedKMeans", "FlatKMeans", "RKM"])
def test_methods_assign_every_point_once(cloud, method):
    points, _ = cloud
    out = methods.partition(points, method, 4).persist()
    assert sorted(r["id"] for r in out.select("id").collect()) == list(range(240))
    if method != "FlatKMeans":
        sizes = [r["size"] for r in shards.shard_sizes(out).collect()]
        assert max(sizes) <= methods.capacity(240, 4) + (4 if method == "OurPyramid" else 0)


@pytest.mark.parametrize("method", ["OGP", "OGPS", "OKM", "OBKM", "ORKM"])
def test_overlaps_hold_the_partition_and_the_cap(cloud, method):
    points, _ = cloud
    out = methods.partition(points, method, 4, 0.2).persist()
    assert out.count() == out.distinct().count()
    assert out.select("id").distinct().count() == 240
    assert 240 <= out.count() <= 240 + 48
    assert max(r["size"] for r in shards.shard_sizes(out).collect()) <= methods.capacity(240, 4)


def test_no_overlap_means_none(cloud):
    points, _ = cloud
    base = methods.partition(points, "RKM", 4)
    assert overlap.overlap_by_centers(points, base, centroids.centers(points, base), 4, overlap=0.0).count() == 240


def test_unknown_method(cloud):
    with pytest.raises(ValueError):
        methods.partition(cloud[0], "None", 4)


def test_graph_partition_cuts_less_than_chance(cloud):
    points, _ = cloud
    edges = graphs.symmetrise(neighbours.exact_graph(points, 10)).persist()
    cut = graphs.edge_cut(edges, methods.partition(points, "GP", 4)).first()
    chance = graphs.edge_cut(edges, shards.random_shards(points, 4)).first()
    assert cut["cut"] < 0.4 * chance["cut"]


def test_coarsening_keeps_cap(cloud, monkeypatch):
    points, _ = cloud
    monkeypatch.setattr(partitioner, "COARSE", 60)
    edges = graphs.symmetrise(neighbours.exact_graph(points, 10)).persist()
    out = partitioner.partition_graph(edges, points.select("id", F.lit(1).cast("long").alias("weight")), 4).persist()
    assert out.count() == 240 and max(r["size"] for r in shards.shard_sizes(out).collect()) <= methods.capacity(240, 4) + 5


def test_tree_with_ample_budget_finds_the_nearest_centroid(cloud, spark):
    points, v = cloud
    assignment = points.select("id", (F.col("id") % 3).cast("int").alias("shard"))
    how = trees.TreeOptions(num_centroids=5, min_cluster_size=10, budget=120, search_budget=10**6, rounds=4)
    built = trees.train_trees(points, assignment, how).persist()
    asked = spark.createDataFrame([(k, (v[k] + 0.05).tolist()) for k in range(10)], "query_id long, qvec array<double>")
    got = trees.query_trees(built, asked, how)
    flat = built.collect()
    for r in got.collect():
        d = min(((np.array(x["vec"]) - v[r["query_id"]] - 0.05) ** 2).sum() for x in flat if x["shard"] == r["shard"])
        assert r["min_dist"] == pytest.approx(d)
    assert got.count() == 30


@pytest.mark.parametrize("metric", ["l2", "mips"])
def test_large_nodes_are_clustered_like_small_ones(cloud, metric, monkeypatch):
    points, _ = cloud
    points = points.select("id", F.transform("vec", lambda x: F.round(x * 64) / 64).alias("vec"))  # sums are exact, in any order
    assignment = points.select("id", (F.col("id") % 3 == 0).cast("int").alias("shard")).persist()
    how = trees.TreeOptions(num_centroids=4, min_cluster_size=10, budget=60, rounds=3)
    monkeypatch.setattr(lloyd, "CENTER_VALUES", 40)  # so that nodes take turns

    def tree(large):
        return sorted((r["shard"], r["node"], r["centroid"], r["child"], tuple(np.round(r["vec"], 9))) for r in trees.train_trees(points, assignment, how, metric, large).collect())

    assert tree(20) == tree(10**6) and len({n for _, n, *_ in tree(10**6)}) > 5
    for large in (20, 300):
        assert rows(centroids.hierarchical_kmeans(points, 0.05, metric=metric, rounds=3, large=large)[0], "id", "leaf") == rows(centroids.hierarchical_kmeans(points, 0.05, metric=metric, rounds=3)[0], "id", "leaf")
        assert rows(centroids.split_shards(points.join(assignment, "id"), 50, metric, 3, large), "id", "part") == rows(centroids.split_shards(points.join(assignment, "id"), 50, metric, 3), "id", "part")


@pytest.mark.parametrize("large", [5, 10**6])
def test_shards_of_copies_are_dealt_evenly(spark, large):
    df = spark.createDataFrame([(i, [1.0, 2.0], 7) for i in range(50)], "id long, vec array<double>, shard int")
    out = centroids.split_shards(df, 20, "l2", 2, large).groupBy("shard", "part").count().collect()
    assert sorted((r["shard"], r["part"], r["count"]) for r in out) == [(7, 0, 17), (7, 1, 17), (7, 2, 16)]


def test_navigable_graph_recall(cloud, spark):
    points, v = cloud
    asked = spark.createDataFrame([(k, (v[k] + 0.1).tolist()) for k in range(0, 240, 8)], "query_id long, qvec array<double>")
    truth = neighbours.ground_truth(points, asked, 10)
    found = trees.graph_search_all(points, asked, 10, 100, trees.GraphOptions(m=8))
    got = recall.distance_recall(found, neighbours.kth_distance(truth, 10), 10, 30).first()[0]
    assert got >= 0.9


def test_sketched_graph_recall(cloud):
    points, _ = cloud
    near = graphs.approximate_graph(points, 10, graphs.Sketch(top_leaders=8, bucket=80, merged=40, tiny=5, fanout=3, repetitions=3))
    assert near.where("src = dst").count() == 0
    assert recall.graph_recall(near, neighbours.exact_graph(points, 10), 240, 10).first()[0] >= 0.9


def test_sketch_cuts_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(50)], "id long, vec array<double>")
    sizes = graphs.sketch_buckets(df, graphs.Sketch(top_leaders=3, bucket=20, merged=10, tiny=2, fanout=1, repetitions=1, max_depth=3)).groupBy("bucket").count().collect()
    assert sum(r["count"] for r in sizes) == 50 and len(sizes) > 1


def test_full_probing_of_a_cover_finds_everything(cloud, spark):
    points, v = cloud
    assignment = methods.partition(points, "FlatKMeans", 5)
    asked = spark.createDataFrame([(k, (v[k] + 0.1).tolist()) for k in range(0, 240, 20)], "query_id long, qvec array<double>")
    routes = routing.brute_force(points, assignment, asked)
    found = search.search_probes(points, assignment, asked, routes, 10)
    hits = search.true_hits(found, neighbours.kth_distance(neighbours.ground_truth(points, asked, 10), 10))
    got = [r for _, r in rows(recall.recall_by_probes(routes, hits, 5, 10, 12), "probes", "recall")]
    assert got == sorted(got) and got[-1] == 1.0
    assert recall.first_shard_recall(neighbours.ground_truth(points, asked, 10), assignment, 10).first()[0] >= got[0]


def test_repaired_truth(cloud, spark):
    points, v = cloud
    asked = spark.createDataFrame([(0, v[0].tolist())], "query_id long, qvec array<double>")
    truth = neighbours.ground_truth(points, asked, 5)
    bent = truth.withColumn("dist", 10 - F.col("dist")).withColumn("rank", 6 - F.col("rank"))
    assert rows(neighbours.repaired_truth(bent, points, asked), "rank", "neighbor_id") == rows(truth, "rank", "neighbor_id")


def test_plan_prunes_and_limits(spark):
    from vectide.plans.queries import QUERIES

    plan = QUERIES["exact_knn_l2"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "label" not in plan.split("FileScan")[1].split("\n")[0]


@pytest.mark.parametrize("metric", ["l2", "mips"])
def test_top_k_of_copies(metric, monkeypatch):
    monkeypatch.setattr(kernels, "PAIRS", 7)
    rng = np.random.default_rng(5)
    points = np.repeat(rng.normal(size=(6, 4)), 5, axis=0)
    ids = rng.permutation(len(points))
    q, found, dist = kernels.top_k(ids, points, ids, points, 8, metric, exclude_self=True, step=11)
    for i, v in zip(ids, points, strict=True):
        d = kernels.distances(points, v, metric)
        want = sorted((x, j) for x, j in zip(d, ids, strict=True) if j != i)[:8]
        assert [(x, j) for x, j in zip(dist[q == i], found[q == i], strict=True)] == want


def test_last_ids(spark):
    rng = np.random.default_rng(3)
    ids = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, 40), rng.integers(0, 200, 150), rng.integers(2**60, 2**61, 60)]))
    table = pd.DataFrame({"id": ids, "shard": rng.integers(0, 5, len(ids)).astype(np.int32)})
    room = {0: 10, 1: 0, 2: 1, 3: 1000}
    df = spark.createDataFrame(table)
    for bins in (2, 3, 1024):
        got = rows(df.where(shards.up_to(shards.last_ids(df, room, bins))), "id", "shard")
        ranked = table.sort_values("id").assign(place=lambda t: t.groupby("shard").cumcount())
        assert got == sorted((r.id, r.shard) for r in ranked.itertuples() if r.place < room.get(r.shard, 0))
    assert shards.last_ids(df.where("false"), room) == {}
