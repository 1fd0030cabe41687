"""Nearest neighbours: exact search in blocks, ground truth, kNN graphs, leaders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import check_metric, distance
from . import kernels

POINT_BLOCK = 16_384
QUERY_BLOCK = 2_048
LEADER_BYTES = 64 << 20  # leaders that go to every executor at most


def rank_within(found: DataFrame, keys: list[str], k: int, order: tuple[str, str] = ("dist", "neighbor_id")) -> DataFrame:
    """The k smallest of each group by (dist, id), with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def block_search(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """(part, query_id, rank, neighbor_id, dist): in each part, the k nearest points(id, vec, part) of queries(query_id, qvec, part).

    Parts are cut into blocks of points and of queries of bounded size, and each block of queries meets each block of points of its
    part in a task; so a part that holds most rows is many tasks. Each task sends k rows for each query only.
    """
    check_metric(metric)
    sizes = points.groupBy("part").agg(F.count(F.lit(1)).alias("np")).join(queries.groupBy("part").agg(F.count(F.lit(1)).alias("nq")), "part")
    sizes = sizes.select("part", F.ceil(F.col("np") / POINT_BLOCK).cast("int").alias("bp"), F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("bq"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, key: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = points.join(sizes, "part").select("part", F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("v"), F.lit(False).alias("ask"), mine("bp", "id").alias("b"), every("bq").alias("a"))
    right = queries.join(sizes, "part").select("part", F.col("query_id").cast("long").alias("id"), F.col("qvec").cast("array<double>").alias("v"), F.lit(True).alias("ask"), every("bp").alias("b"), mine("bq", "query_id").alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 3):
            ask = block.column("ask").to_numpy(zero_copy_only=False)
            if ask.all() or not ask.any():
                continue
            ids, v = block.column("id").to_numpy(zero_copy_only=False), as_matrix(block.column("v"))
            q, found, dist = kernels.top_k(ids[~ask], v[~ask], ids[ask], v[ask], k, metric, exclude_self)
            part = pa.repeat(block.column("part")[0], len(q))
            yield pa.RecordBatch.from_arrays([part, pa.array(q), pa.array(found), pa.array(dist)], names=["part", "query_id", "neighbor_id", "dist"])

    kind = dict(points.dtypes)["part"]
    # like a grouped map, but small blocks cost no call of their own
    dealt = left.unionByName(right).select("part", "a", "b", "id", "v", "ask").repartition("part", "a", "b").sortWithinPartitions("part", "a", "b")
    found = dealt.mapInArrow(run, f"part {kind}, query_id long, neighbor_id long, dist double")
    return rank_within(found, ["part", "query_id"], k).select("part", "query_id", "rank", "neighbor_id", "dist")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Of sorted batches, the runs of rows whose first so many columns are equal, each as one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c, column in enumerate(columns):
            change[0] |= bool(held) and held[-1].column(c)[-1] != column[0]
            if batch.num_rows > 1:
                change[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        at = 0
        for end in [*np.flatnonzero(change).tolist(), None]:
            if end is None:
                if at < batch.num_rows:
                    held.append(batch.slice(at))
                break
            if end > at:
                held.append(batch.slice(at, end - at))
            if held:
                yield _joined(held)
            held, at = [], end
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def ground_truth(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, neighbor_id, dist): the k nearest points(id, vec) of each of queries(query_id, qvec), ties to the smaller id."""
    one = F.lit(0).alias("part")
    return block_search(points.select("id", "vec", one), queries.select("query_id", "qvec", one), k, metric, exclude_self).drop("part")


def kth_distance(truth: DataFrame, k: int) -> DataFrame:
    """(query_id, kth): the distance of the k-th neighbour; of the last, if there are fewer."""
    return truth.where(F.col("rank") <= k).groupBy("query_id").agg(F.max("dist").alias("kth"))


def exact_graph(points: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Edges (src, dst, rank, dist) to each point's k nearest other points."""
    asked = points.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    return ground_truth(points, asked, k, metric, exclude_self=True).select(F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst"), "rank", "dist")


def nearest_in_parts(rows: DataFrame, leaders: DataFrame, k: int, metric: str = "l2", keep: tuple[str, ...] = ()) -> DataFrame:
    """(part, id, rank, leader, dist): the k nearest leaders(id, vec, part) of each of rows(id, vec, part) in its part.

    Leaders of at most LEADER_BYTES in all go to executors, and rows aren't shuffled; more leaders meet the rows in blocks. Both
    ways give the same. Columns of rows named in keep come along.
    """
    kind = dict(rows.dtypes)["part"]
    given = leaders.select("part", F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    head = given.first()
    if head is None:
        return rows.where("false").select("part", F.col("id").cast("long").alias("id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("leader"), F.lit(0.0).alias("dist"), *keep)
    most = max(1, LEADER_BYTES // (8 * max(1, len(head["vec"])) + 16))
    held = given.limit(most + 1).collect()
    if len(held) > most:
        asked = rows.select("part", F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
        found = block_search(leaders.select("part", "id", "vec"), asked, k, metric)
        found = found.select("part", F.col("query_id").alias("id"), F.col("rank").cast("int").alias("rank"), F.col("neighbor_id").alias("leader"), "dist")
        return found.join(rows.select("part", F.col("id").cast("long").alias("id"), *keep), ["part", "id"]) if keep else found
    by: dict = {}
    for r in held:
        by.setdefault(r["part"], []).append(r)
    sent = rows.sparkSession.sparkContext.broadcast({p: (np.array([r["id"] for r in own], np.int64), np.array([r["vec"] for r in own], float)) for p, own in by.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            part, ids = np.array(b.column(0).to_pylist()), b.column(1).to_numpy(zero_copy_only=False)
            v = as_matrix(b.column(2))
            for p in np.unique(part):
                if p.item() not in sent.value:
                    continue
                own = np.flatnonzero(part == p)
                at, center = sent.value[p.item()]
                if k == 1:
                    order = np.argsort(at, kind="stable")
                    index, dist = kernels.nearest_center(v[own], center[order], metric)
                    row, found, rank = own, at[order][index], np.ones(len(own), np.int32)
                else:
                    row, found, dist = kernels.top_k(at, center, own, v[own], k, metric)
                    rank = (np.arange(len(row)) - np.searchsorted(row, row) + 1).astype(np.int32)
                along = [b.column(c).take(pa.array(row)) for c in range(3, b.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array([p.item()] * len(row), b.schema.field(0).type), pa.array(ids[row]), pa.array(rank), pa.array(found), pa.array(dist), *along], names=["part", "id", "rank", "leader", "dist", *keep])

    whole = rows.select("part", F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    kept = "".join(f", {c} {dict(rows.dtypes)[c]}" for c in keep)
    return whole.mapInArrow(run, f"part {kind}, id long, rank int, leader long, dist double{kept}")


def as_matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, without Python objects."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1)


def closest_leaders(points: DataFrame, leaders: DataFrame, k: int, metric: str = "l2", farthest_first: bool = False) -> DataFrame:
    """(id, rank, leader, dist): the k nearest leaders(id, vec) of each point."""
    one = F.lit(0).alias("part")
    out = nearest_in_parts(points.select("id", "vec", one), leaders.select("id", "vec", one), k, check_metric(metric)).select("id", "rank", "leader", "dist")
    if farthest_first:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("dist"), F.desc("leader"))))
    return out


def bucket_graph(points: DataFrame, buckets: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Edges to the k nearest points that share a bucket: buckets(bucket, id) may overlap and repeat; neighbours met twice count once."""
    own = buckets.distinct().join(points, "id").select("id", "vec", F.col("bucket").alias("part"))
    found = block_search(own, own.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"), "part"), k, metric, exclude_self=True)
    return merge_neighbours(found.select(F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst"), "dist"), k)


def merge_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """Distinct (src, dst) with the smallest distance, the k nearest of each src."""
    once = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return rank_within(once, ["src"], k, ("dist", "dst")).select("src", "dst", "rank", "dist")


def dedup_neighbours(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, neighbor_id, dist): neighbours that several shards returned count once."""
    return rank_within(found.groupBy("query_id", "neighbor_id").agg(F.min("dist").alias("dist")), ["query_id"], k).select("query_id", "rank", "neighbor_id", "dist")


def truth_audit(truth: DataFrame, points: DataFrame, queries: DataFrame, metric: str = "l2", digits: range = range(1, 11)) -> DataFrame:
    """(eps_digits, mismatches, unsorted): stored distances that differ from true ones by more than 10^-digits, and lists out of order."""
    both = truth.join(points, F.col("neighbor_id") == F.col("id")).join(queries, "query_id")
    true = both.select("query_id", "rank", "dist", distance(F.col("vec"), F.col("qvec"), metric).alias("true"))
    before = F.lag("dist").over(Window.partitionBy("query_id").orderBy("rank"))
    lists = true.withColumn("late", F.coalesce(before > F.col("dist"), F.lit(False))).groupBy("query_id").agg(F.bool_or("late").alias("late"), *[F.count_if(F.abs(F.col("dist") - F.col("true")) > 10.0**-d).alias(f"m{d}") for d in digits])
    sums = lists.agg(F.sum(F.col("late").cast("long")).alias("unsorted"), *[F.sum(f"m{d}").alias(f"m{d}") for d in digits])
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("eps_digits"), F.col(f"m{d}").alias("mismatches")) for d in digits]))
    return sums.select(rows.alias("r"), "unsorted").select("r.eps_digits", "r.mismatches", "unsorted")


def repaired_truth(truth: DataFrame, points: DataFrame, queries: DataFrame, metric: str = "l2") -> DataFrame:
    """truth with distances computed anew and lists sorted anew."""
    both = truth.join(points, F.col("neighbor_id") == F.col("id")).join(queries, "query_id")
    fresh = both.select("query_id", "neighbor_id", distance(F.col("vec"), F.col("qvec"), metric).alias("dist"))
    return rank_within(fresh, ["query_id"], 2**31 - 1).select("query_id", "rank", "neighbor_id", "dist")
