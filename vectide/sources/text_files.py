"""Text formats: one shard a line, one shard's ids a line, METIS graphs, routes and shard searches."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shards import compact_ids

ROUTE_FIELDS = ("algorithm", "trainer", "votes", "ef", "routing_time", "increasing", "budget", "num_centroids", "min_cluster_size")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one file with their numbers from 0."""
    return spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0])).toDF("n long, value string")


def _write_lines(lines: DataFrame, path: str, head: str | None = None) -> None:
    """(n, value) as one file, by n, streamed in order."""
    tmp = f"{path}.part"
    with open(tmp, "w") as f:
        if head is not None:
            f.write(head + "\n")
        for r in lines.orderBy("n").select("value").toLocalIterator():
            f.write(r["value"] + "\n")
    os.replace(tmp, path)


def read_assignment(spark: SparkSession, path: str, compact: bool = True) -> DataFrame:
    """(id, shard): line i holds the shard of point i. Gaps in shard ids are closed."""
    out = _lines(spark, path).select(F.col("n").alias("id"), F.trim("value").cast("int").alias("shard"))
    return compact_ids(out) if compact else out


def write_assignment(assignment: DataFrame, path: str) -> None:
    _write_lines(assignment.select(F.col("id").alias("n"), F.col("shard").cast("string").alias("value")), path)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(id, shard): line c holds the ids of shard c; an id may stand in several."""
    lined = _lines(spark, path).select(F.col("n").cast("int").alias("shard"), F.explode(F.split(F.trim("value"), r"\s+")).alias("id"))
    return lined.where("id <> ''").select(F.col("id").cast("long").alias("id"), "shard")


def write_clusters(assignment: DataFrame, path: str) -> None:
    most = assignment.agg(F.max("shard")).first()[0]
    every = assignment.sparkSession.range(0 if most is None else most + 1).select(F.col("id").cast("int").alias("shard"))
    own = assignment.groupBy("shard").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), " ").alias("value"))
    _write_lines(every.join(own, "shard", "left").select(F.col("shard").alias("n"), F.coalesce("value", F.lit("")).alias("value")), path)


def write_graph(edges: DataFrame, n_points: int, path: str) -> None:
    """METIS: 'points edges', then each point's neighbours from 1. edges(src, dst) hold both directions."""
    m = edges.count()
    if m % 2:
        raise ValueError("the number of directed edges is odd; symmetrise the graph first")
    own = edges.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda x: (x + 1).cast("string")), " ").alias("value"))
    every = edges.sparkSession.range(n_points)
    _write_lines(every.join(own, F.col("id") == F.col("src"), "left").select(F.col("id").alias("n"), F.coalesce("value", F.lit("")).alias("value")), path, f"{n_points} {m // 2}")


def write_routes(configs: DataFrame, routes: DataFrame, path: str) -> None:
    """Count, then for each route: R, its fields, the number of queries, and a line of shards for each query."""
    heads = sorted(configs.collect(), key=lambda r: r["route_id"])
    lists = routes.groupBy("route_id", "query_id").agg(F.array_sort(F.collect_list(F.struct("probe_rank", "shard"))).alias("l"))
    lines = lists.select("route_id", "query_id", F.array_join(F.transform("l", lambda x: x["shard"].cast("string")), " ").alias("value")).orderBy("route_id", "query_id")
    counts = {r["route_id"]: r["n"] for r in lists.groupBy("route_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    with open(path, "w") as f:
        f.write(f"{len(heads)}\n")
        rows = lines.toLocalIterator()
        for h in heads:
            n = counts.get(h["route_id"], 0)
            f.write("R\n" + " ".join(str(int(h[c]) if isinstance(h[c], bool) else h[c]) for c in ROUTE_FIELDS) + f" {n}\n")
            for _ in range(n):
                f.write(next(rows)["value"] + "\n")


def read_routes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(configs, routes). Query ids are line numbers."""
    lines = Path(path).read_text().split("\n")
    configs, routes, at = [], [], 1
    for route in range(int(lines[0])):
        if lines[at] != "R":
            raise ValueError(f"{path}, line {at + 1}: R expected")
        x = lines[at + 1].split(" ")
        configs.append((route, x[0], x[1], int(x[2]), int(x[3]), float(x[4]), bool(int(x[5])), int(x[6]), int(x[7]), int(x[8])))
        at += 2
        for q in range(int(x[9])):
            routes += [(route, q, p + 1, int(s)) for p, s in enumerate(lines[at].split())]
            at += 1
    schema = "route_id int, algorithm string, trainer string, votes long, ef long, routing_time double, increasing boolean, budget long, num_centroids long, min_cluster_size long"
    return spark.createDataFrame(configs, schema), spark.createDataFrame(routes, "route_id int, query_id long, probe_rank int, shard int")


def write_searches(hits: DataFrame, times: DataFrame, path: str) -> None:
    """Count, then for each beam width: S, 'ef shards queries', a line of neighbours for each shard and query, then a line of times for each shard."""
    found = {}
    for r in hits.toLocalIterator():
        found.setdefault((r["ef"], r["shard"], r["query_id"]), []).append(r["neighbor_id"])
    took = {(r["ef"], r["shard"], r["query_id"]): r["seconds"] for r in times.toLocalIterator()}
    with open(path, "w") as f:
        efs = sorted({k[0] for k in took})
        f.write(f"{len(efs)}\n")
        for ef in efs:
            shards, queries = max(k[1] for k in took if k[0] == ef) + 1, max(k[2] for k in took if k[0] == ef) + 1
            f.write(f"S\n{ef} {shards} {queries}\n")
            for s in range(shards):
                for q in range(queries):
                    f.write(" ".join(map(str, found.get((ef, s, q), []))) + "\n")
            for s in range(shards):
                f.write(" ".join(repr(took.get((ef, s, q), 0.0)) for q in range(queries)) + "\n")


def read_searches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hits, times)."""
    lines = Path(path).read_text().split("\n")
    hits, times, at = [], [], 1
    for _ in range(int(lines[0])):
        if lines[at] != "S":
            raise ValueError(f"{path}, line {at + 1}: S expected")
        ef, shards, queries = map(int, lines[at + 1].split())
        at += 2
        for s in range(shards):
            for q in range(queries):
                hits += [(ef, s, q, int(x)) for x in lines[at].split()]
                at += 1
        for s in range(shards):
            times += [(ef, s, q, float(x)) for q, x in enumerate(lines[at].split())]
            at += 1
    return spark.createDataFrame(hits, "ef int, shard int, query_id long, neighbor_id long"), spark.createDataFrame(times, "ef int, shard int, query_id long, seconds double")


def hits_of_counts(counts: DataFrame) -> DataFrame:
    """(ef, shard, query_id, neighbor_id) from counts(ef, shard, query_id, hits) of the older format: made-up ids, no two alike for a query."""
    before = Window.partitionBy("ef", "query_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.where("hits > 0").withColumn("off", F.coalesce(F.sum("hits").over(before), F.lit(0)))
    return placed.select("ef", "shard", "query_id", F.explode(F.sequence((F.col("off") + 1).cast("long"), (F.col("off") + F.col("hits")).cast("long"))).alias("neighbor_id"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)
