import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vectide.operators import methods, neighbours, recall, routing, search, trees
from vectide.plans import sweeps
from vectide.plans.queries import QUERIES, SQL
from vectide.sources import shard_store


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(160, 6)) + np.repeat(rng.normal(size=(4, 6)) * 3, 40, axis=0)
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(160), "vec": [x.tolist() for x in v]})).persist()
    queries = spark.createDataFrame([(k, (v[k] + 0.1).tolist()) for k in range(0, 160, 16)], "query_id long, qvec array<double>").persist()
    return points, queries, methods.partition(points, "RKM", 4).persist()


def test_attribution_front(small):
    points, queries, assignment = small
    how = trees.TreeOptions(num_centroids=4, min_cluster_size=20, budget=40, search_budget=1000, rounds=3)
    table, front = sweeps.query_attribution(points, assignment, queries, 5, how, vote_counts=(10,), extra_hosts=3)
    rows, best = table.persist(), [(r["recall"], r["qps"]) for r in front.collect()]
    assert not any(a[0] <= b[0] and a[1] <= b[1] and a != b for a in best for b in best)
    assert rows.agg(F.max("recall")).first()[0] == 1.0
    full = rows.where("probes = 4 and route_id = 0").select("recall").distinct().collect()
    assert [r[0] for r in full] == [1.0]


def test_timed_attribution(small):
    points, queries, assignment = small
    how = trees.TreeOptions(num_centroids=4, min_cluster_size=20, budget=40, search_budget=1000, rounds=3)
    table, front = sweeps.query_attribution(points, assignment, queries, 5, how, [20, 60], vote_counts=(10,), extra_hosts=1, timed=True)
    rows = table.where("route_id = 0 and probes = 4").collect()
    assert {r["ef"] for r in rows} == {20, 60} and all(0 < r["latency"] < 5 for r in rows) and front.count() >= 1
    with pytest.raises(ValueError):
        sweeps.query_attribution(points, assignment, queries, 5, how, timed=True)


def test_all_route_sets(small):
    points, queries, assignment = small
    configs = [{"route_config": c, "budget": b, "num_centroids": 4, "min_cluster_size": 20} for c, b in enumerate((20, 60))]
    got = sweeps.all_route_sets(points, assignment, queries, configs, (10,)).groupBy("route_config", "algorithm").agg(F.count_distinct("route_id").alias("n")).collect()
    seen = {(r["route_config"], r["algorithm"]): r["n"] for r in got}
    names = ("tree", "tree-frequency", "nearest", "pyramid", "spann", "frequency")
    assert seen == {(0, "random"): 1, **{(c, name): 1 for c in (0, 1) for name in names}}
    configs = routing.router_configs(10**6)
    assert len(configs) == 10 and [c["budget"] for c in configs if c["num_centroids"] == 128] == [5_000_000, 10_000_000]


def test_saved_index_finds_the_same(small, spark, tmp_path):
    points, queries, assignment = small
    how = trees.GraphOptions(m=6, block=25)  # several blocks for each shard
    own, asked = search.shard_points(points, assignment), queries.crossJoin(assignment.select(F.col("shard").alias("part")).distinct())
    trees.graph_index(own, how).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    found = [sorted(map(tuple, df.collect())) for df in (trees.search_index(index, asked, 5, [30]), trees.graph_search(own, asked, 5, [30], how))]
    assert found[0] == found[1] and len(found[0]) == 10 * 4 * 5
    took = trees.search_times(index, asked, 5, [10, 30], 3).collect()
    assert len(took) == 8 and all(r["seconds"] > 0 for r in took)
    assert trees.search_index(index.where("false"), asked, 5, [30]).count() == 0


def test_drivers(small):
    points, queries, assignment = small
    swept = {r["ef"]: r["recall"] for r in sweeps.ef_sweep(points, queries, 5, (5, 80), trees.GraphOptions(m=8)).collect()}
    assert swept[80] >= max(0.9, swept[5])
    how = trees.TreeOptions(num_centroids=4, min_cluster_size=20, budget=40, search_budget=1000, rounds=3)
    got = {(r["routing"], r["shard_query"], r["probes"]): r["recall"] for r in sweeps.small_scale(points, assignment, queries, 5, how).collect()}
    assert len(got) == 2 * 2 * 4
    for router in ("tree", "graph"):
        assert got[router, "all points", 4] == 1.0 and got[router, "graph", 4] >= 0.9
    truth = neighbours.ground_truth(points, queries, 5)
    best = {r["probes"]: r["recall"] for r in recall.disjoint_oracle_recall(truth, assignment, 5).collect()}
    assert max(best.values()) == 1.0 and all(best.get(p, 1.0) >= got[r, s, p] - 1e-9 for r, s, p in got)


def test_losses(small):
    points, queries, assignment = small
    got = {(r["router"], r["probes"]): r["recall"] for r in sweeps.loss_analysis(points, assignment, queries, 5, 60).collect()}
    assert len(got) == 24
    for p in range(1, 5):
        assert all(got["oracle", p] >= got[name, p] - 1e-9 for name, q in got if q == p)


def test_graph_quality_and_partition_sweep(small):
    points, queries, _ = small
    got = sweeps.graph_quality(points, queries, 5, 3, [(1, 2, 60)], (5,))
    assert got[0]["graph_recall"] == 1.0 and 0 < got[1]["graph_recall"] <= 1
    assert [r["method"] for r in sweeps.partition_sweep(points, ["Random", "RKM"], [4])] == ["Random", "RKM"]


def test_shard_store_prunes(small, spark, tmp_path):
    points, _, assignment = small
    shard_store.write_shards(points, assignment, str(tmp_path / "s"))
    one = shard_store.read_shards(spark, str(tmp_path / "s"), [2])
    assert one.count() == assignment.where("shard = 2").count()
    filters = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "shard" in filters


def test_names():
    assert SQL.keys() <= QUERIES.keys() and len(QUERIES) > 80
