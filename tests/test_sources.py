import struct

import numpy as np
import pytest

from vectide.sources import text_files as T
from vectide.sources import vector_files as B


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_vectors_round_trip(spark, tmp_path):
    v = np.random.default_rng(0).normal(size=(50, 6)).astype("f4")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>")
    path = str(tmp_path / "a.fbin")
    B.write_points(df.repartition(5), path)
    B.register(spark)
    back = spark.read.format("vectors").option("rows", 7).load(path)
    assert back.rdd.getNumPartitions() == 8
    assert rows(back, "id", "vec") == rows(df, "id", "vec")
    assert B.read_points(spark, path, 3).count() == 3


@pytest.mark.parametrize(("ending", "kind"), [(".u8bin", "u1"), (".i8bin", "i1")])
def test_bytes(spark, tmp_path, ending, kind):
    v = np.arange(-6, 6).astype(kind).reshape(4, 3)
    path = tmp_path / f"a{ending}"
    path.write_bytes(struct.pack("<II", 4, 3) + v.tobytes())
    assert rows(B.read_points(spark, str(path), 2), "id", "vec") == [(i, v[i].astype(float).tolist()) for i in range(2)]


def test_bad_files(spark, tmp_path):
    with pytest.raises(ValueError):
        B.read_points(spark, str(tmp_path / "a.npy"))
    short = tmp_path / "a.fbin"
    short.write_bytes(struct.pack("<II", 4, 3))
    with pytest.raises(Exception, match="shorter"):
        B.read_points(spark, str(short)).count()


def test_truth_round_trip(spark, tmp_path):
    data = [(q, r, 10 * q + r, r / 2) for q in range(5) for r in (1, 2, 3)]
    df = spark.createDataFrame(data, "query_id long, rank int, neighbor_id long, dist double")
    B.write_truth(df.repartition(3), str(tmp_path / "gt.bin"))
    assert rows(B.read_truth(spark, str(tmp_path / "gt.bin")), "query_id", "rank", "neighbor_id", "dist") == data
    with pytest.raises(ValueError):
        B.write_truth(df.where("query_id > 0 or rank < 3"), str(tmp_path / "no.bin"))


def test_assignment_and_clusters(spark, tmp_path):
    a = spark.createDataFrame([(0, 5), (1, 0), (2, 2), (3, 5)], "id long, shard int")
    T.write_assignment(a, str(tmp_path / "p"))
    assert (tmp_path / "p").read_text() == "5\n0\n2\n5\n"
    assert rows(T.read_assignment(spark, str(tmp_path / "p")), "id", "shard") == [(0, 2), (1, 0), (2, 1), (3, 2)]
    c = spark.createDataFrame([(0, 0), (1, 0), (1, 2)], "id long, shard int")
    T.write_clusters(c, str(tmp_path / "c"))
    assert (tmp_path / "c").read_text() == "0 1\n\n1\n"
    assert rows(T.read_clusters(spark, str(tmp_path / "c")), "id", "shard") == rows(c, "id", "shard")


def test_graph(spark, tmp_path):
    e = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "src long, dst long")
    T.write_graph(e, 4, str(tmp_path / "g"))
    assert (tmp_path / "g").read_text() == "4 2\n2\n1 3\n2\n\n"
    with pytest.raises(ValueError):
        T.write_graph(e.limit(3), 4, str(tmp_path / "h"))


def test_routes(spark, tmp_path):
    configs = spark.createDataFrame([(0, "Tree", "KM", 20, 50, 0.5, True, 100, 64, 350), (1, "Pyramid", "KM", 40, 50, 1.5, False, 100, 64, 350)], "route_id int, algorithm string, trainer string, votes long, ef long, routing_time double, increasing boolean, budget long, num_centroids long, min_cluster_size long")
    routes = spark.createDataFrame([(r, q, p + 1, s) for r in (0, 1) for q in (0, 1) for p, s in enumerate((3, q, 2)[: 3 - r])], "route_id int, query_id long, probe_rank int, shard int")
    T.write_routes(configs, routes, str(tmp_path / "r"))
    c, back = T.read_routes(spark, str(tmp_path / "r"))
    assert rows(c, *configs.columns) == rows(configs, *configs.columns) and rows(back, *routes.columns) == rows(routes, *routes.columns)
    (tmp_path / "bad").write_text("1\nX\n")
    with pytest.raises(ValueError):
        T.read_routes(spark, str(tmp_path / "bad"))


def test_searches(spark, tmp_path):
    hits = spark.createDataFrame([(50, 0, 0, 7), (50, 1, 1, 8), (50, 1, 1, 9)], "ef int, shard int, query_id long, neighbor_id long")
    times = spark.createDataFrame([(50, s, q, 0.25 * s + q) for s in (0, 1) for q in (0, 1)], "ef int, shard int, query_id long, seconds double")
    T.write_searches(hits, times, str(tmp_path / "s"))
    h, t = T.read_searches(spark, str(tmp_path / "s"))
    assert rows(h, *hits.columns) == rows(hits, *hits.columns) and rows(t, *times.columns) == rows(times, *times.columns)


def test_hits_of_counts_are_distinct(spark):
    counts = spark.createDataFrame([(50, 0, 0, 2), (50, 1, 0, 3), (50, 2, 0, 0)], "ef int, shard int, query_id long, hits int")
    out = T.hits_of_counts(counts)
    assert rows(out, "shard", "neighbor_id") == [(0, 1), (0, 2), (1, 3), (1, 4), (1, 5)]
