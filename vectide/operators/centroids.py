"""Centers, Lloyd's k-means, balanced and hierarchical variants."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import check_metric, normalise, positive_distance, squared_norm
from ..sources.shared import materialize
from . import kernels
from .lloyd import LARGE, keyed, lloyd_round, node_kmeans, split_by_size
from .neighbours import as_matrix
from .shards import last_ids, random_sample, random_shards, up_to

SEED = 555


def center_values(points: DataFrame, assignment: DataFrame, metric: str = "l2") -> DataFrame:
    """(shard, pos, value): centers in long form; partial sums are combined before the shuffle."""
    own = points.join(assignment, "id").select("shard", F.col("vec").cast("array<double>").alias("vec"))
    if check_metric(metric) == "l2":
        return own.select("shard", F.posexplode("vec").alias("pos", "x")).groupBy("shard", "pos").agg(F.avg("x").alias("value"))
    long = own.select("shard", F.posexplode(normalise(F.col("vec"))).alias("pos", "x")).groupBy("shard", "pos").agg(F.sum("x").alias("s"))
    lengths = own.groupBy("shard").agg(F.avg(squared_norm(F.col("vec"))).alias("n2"))
    totals = long.groupBy("shard").agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    return long.join(lengths, "shard").join(totals, "shard").select("shard", "pos", (F.col("s") * F.sqrt(F.col("n2") / F.col("s2"))).alias("value"))


def centers(points: DataFrame, assignment: DataFrame, metric: str = "l2") -> DataFrame:
    """(shard, vec)."""
    gathered = center_values(points, assignment, metric).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return gathered.select("shard", F.transform("v", lambda x: x["value"]).alias("vec"))


def assign(points: DataFrame, at: np.ndarray, metric: str = "l2") -> DataFrame:
    """(id, shard, dist): the nearest of the given centers, the lowest number at a tie. Only centers go to executors; no shuffle."""
    sent = points.sparkSession.sparkContext.broadcast(np.asarray(at, dtype=float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = as_matrix(b.column(1)) if b.num_rows else np.empty((0, 1))
            index, dist = kernels.nearest_center(v, sent.value, metric) if b.num_rows else (np.empty(0, np.int64), np.empty(0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(index.astype(np.int32)), pa.array(dist)], names=["id", "shard", "dist"])

    return points.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "id long, shard int, dist double")


def objective(points: DataFrame, assignment: DataFrame, at: DataFrame, metric: str = "l2") -> DataFrame:
    """(objective): the sum of positive distances to the own center(shard, vec)."""
    both = points.join(assignment, "id").join(at.select("shard", F.col("vec").alias("center")), "shard")
    return both.agg(F.sum(positive_distance(F.col("vec"), F.col("center"), metric)).alias("objective"))


def kmeans(points: DataFrame, start: np.ndarray, metric: str = "l2", rounds: int = 20) -> tuple[DataFrame, np.ndarray]:
    """(assignment(id, shard, dist), centers) after exactly so many rounds. The assignment is one step behind the centers."""
    at = np.asarray(start, dtype=float)
    for _ in range(rounds - 1):
        at = lloyd_round(points, at, check_metric(metric))[1]
    last = lloyd_round(points, at, metric)[1]
    return _compact(assign(points, at, metric)), last


def _compact(assigned: DataFrame) -> DataFrame:
    used = assigned.select("shard").distinct().withColumn("to", (F.dense_rank().over(Window.orderBy("shard")) - 1).cast("int"))
    return assigned.join(F.broadcast(used), "shard").select("id", F.col("to").alias("shard"), "dist")  # one row for each center


def sample_vectors(points: DataFrame, m: int, seed: int = SEED) -> np.ndarray:
    """m vectors for the driver; m is a number of centers."""
    rows = random_sample(points, m, seed).collect()
    return np.array([r["vec"] for r in sorted(rows, key=lambda r: r["id"])], dtype=float)


def flat_kmeans(points: DataFrame, k: int, metric: str = "l2", rounds: int = 20) -> DataFrame:
    return kmeans(points, sample_vectors(points, k), metric, rounds)[0].select("id", "shard")


def evict_overloaded(points: DataFrame, assignment: DataFrame, at: np.ndarray, cap: int, metric: str = "l2") -> DataFrame:
    """(id, shard): shards over cap give up their highest ids, one by one to the nearest center with room; centers stay.

    Their order is by shard, and by id descending. All shards prefer points in this one order, so taking turns gives the same as
    deferred acceptance: in each round every point asks the nearest shard that hasn't turned it down, and a shard keeps as many of
    those that ask as it has room for, the first in order. No points meet in one task but those that ask one shard, as a sorted stream.
    """
    placed = materialize(assignment.select("id", "shard"), "placed")
    within = up_to(last_ids(placed, dict.fromkeys(range(len(at)), cap)))
    stay, out = placed.where(within), placed.where(~within).select("id", F.col("shard").alias("home"))
    sizes = {r["shard"]: r["n"] for r in stay.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    room = [cap - sizes.get(c, 0) for c in range(len(at))]
    if sum(room) < out.count():
        raise ValueError("the shards have less room than there are points")
    sent = points.sparkSession.sparkContext.broadcast(np.asarray(at, dtype=float))

    def prefer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(2).to_pylist(), dtype=float).reshape(b.num_rows, -1)
            d = np.stack([kernels.distances(v, c, metric) for c in sent.value], axis=1) if b.num_rows else np.empty((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(np.argsort(d, axis=1, kind="stable").astype(np.int32)), pa.list_(pa.int32()))], names=["id", "home", "choices"])

    asked = out.join(points, "id").select(F.col("id").cast("long").alias("id"), "home", F.col("vec").cast("array<double>").alias("vec"))
    state = materialize(asked.mapInArrow(prefer, "id long, home int, choices array<int>").withColumn("turn", F.lit(0)), "evicted")
    has = F.array(*[F.lit(r) for r in room])
    order = Window.partitionBy("to").orderBy("home", F.desc("id"))
    while True:
        ranked = state.withColumn("to", F.get("choices", F.col("turn"))).withColumn("r", F.row_number().over(order))
        turned = ranked.withColumn("no", F.col("r") > F.get(has, F.col("to")))
        state = materialize(turned.select("id", "home", "choices", (F.col("turn") + F.col("no").cast("int")).alias("turn"), "no"), "evicted")
        if state.where("no").isEmpty():
            return stay.unionByName(state.select("id", F.get("choices", F.col("turn")).alias("shard")))
        state = state.drop("no")


def recursive_kmeans(points: DataFrame, k: int, cap: int, metric: str = "l2", rounds: int = 20, large: int = LARGE) -> DataFrame:
    """(id, shard): k-means, then each shard over cap is clustered again into ceil(size / cap) parts, all shards of a level in one job.

    The first part keeps the shard's id, others get the next free ones; so there may be more than k shards.
    """
    now = flat_kmeans(points, k, metric, rounds)
    while True:
        now = materialize(now, "level")
        sizes = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        over = {s: n for s, n in sizes.items() if n > cap}
        if not over:
            return now
        labels = split_shards(points.join(now.where(F.col("shard").isin(list(over))), "id"), cap, metric, rounds, large)
        parts = {r["shard"]: r["m"] for r in labels.groupBy("shard").agg(F.max("part").alias("m")).collect()}
        nxt, start = max(sizes) + 1, {}
        for s in sorted(parts):
            start[s] = nxt
            nxt += parts[s]
        first = F.create_map(*[F.lit(x) for s, n in start.items() for x in (s, n)])
        moved = labels.select("id", F.when(F.col("part") == 0, F.col("shard")).otherwise(first[F.col("shard")] + F.col("part") - 1).cast("int").alias("shard"))
        now = now.where(~F.col("shard").isin(list(over))).unionByName(moved)


def split_shards(rows: DataFrame, cap: int, metric: str, rounds: int = 20, large: int = LARGE) -> DataFrame:
    """(id, shard, part): each shard of rows(id, vec, shard) clustered into ceil(size / cap) parts by itself; equal points are dealt evenly.

    Shards of more than so many values are clustered by all tasks, others by one task each.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        v, ids = np.stack(pdf["vec"].to_numpy()).astype(float), pdf["id"].to_numpy()
        part, _ = kernels.lloyd(v, v[kernels.sample_rows(ids, ceil(len(pdf) / cap), SEED)], metric, rounds)
        return pd.DataFrame({"id": ids, "shard": pdf["shard"].to_numpy(), "part": part})

    small, rest, sizes = split_by_size(keyed(rows.select("id", "vec", "shard"), "shard"), "shards", large)
    labels = small.drop("node").groupBy("shard").applyInPandas(run, "id long, shard int, part long")
    if rest is not None:
        placed, _ = node_kmeans(rest, {s: (ceil(n / cap), SEED) for s, n in sizes.items()}, metric, rounds)
        labels = labels.unionByName(placed.select("id", "shard", F.col("part").cast("long").alias("part")))
    labels = materialize(labels, "split")
    alike = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.max("part").alias("m"), F.count(F.lit(1)).alias("n")).where("m = 0").collect() if r["n"] > cap}
    if not alike:
        return labels
    out = labels.where(~F.col("shard").isin(list(alike)))
    for s, n in sorted(alike.items()):
        dealt = random_shards(labels.where(F.col("shard") == s), ceil(n / cap), SEED)
        out = out.unionByName(dealt.select("id", F.lit(s).cast("int").alias("shard"), F.col("shard").cast("long").alias("part")))
    return materialize(out, "split")


def balanced_kmeans(points: DataFrame, k: int, cap: int, metric: str = "l2", rounds: int = 20, sweeps: int = 30) -> DataFrame:
    """(id, shard) of at most cap points each: k-means, then sweeps in which points move by distance plus a growing price of size.

    A sweep is one job: all points see the sizes before it, and shards lose no more than their excess. The price starts where the
    cheapest needed move is and grows by a factor. The first assignment within cap is taken; what is still over cap after so many sweeps
    is evicted.
    """
    assigned, at = kmeans(points, sample_vectors(points, k), metric, rounds)
    at = at.copy()
    now = materialize(assigned.select("id", "shard"), "balanced")
    price = 0.0
    for sweep in range(sweeps):
        size = np.zeros(len(at))
        for r in now.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():
            size[r["shard"]] = r["n"]
        if size.max() <= cap:
            return now
        moved = materialize(_priced(points.join(now, "id"), at, size, price, cap, metric), "balanced")
        need = moved.agg(F.min("need")).first()[0]
        price = (1.5009 - 0.0009 * sweep) * need if need is not None and np.isfinite(need) and need > price else max(price, 1e-9) * 1.5
        now = moved.select("id", "shard")
    return evict_overloaded(points, now, at, cap, metric)


def _priced(rows: DataFrame, at: np.ndarray, size: np.ndarray, price: float, cap: int, metric: str) -> DataFrame:
    """(id, shard, need): points of overloaded shards move where distance + price * size is less.

    need: the smallest price at which a point that stays would leave. A shard loses no more than its excess: the least costly moves go.
    Only points that would move are put in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v, own = np.stack(pdf["vec"].to_numpy()).astype(float), pdf["shard"].to_numpy()
            d = np.stack([kernels.distances(v, c, metric) for c in at], axis=1)
            mine = d[np.arange(len(v)), own]
            less = size[None, :] < size[own][:, None]
            need = np.where(less, (d - mine[:, None]) / np.where(less, size[own][:, None] - size[None, :], 1), np.inf)
            need[:, size >= cap] = np.inf
            to = need.argmin(axis=1)
            lowest = need[np.arange(len(v)), to]
            go = (size[own] > cap) & (lowest <= price)
            yield pd.DataFrame({"id": pdf["id"], "shard": own, "to": np.where(go, to, own).astype(np.int32), "gain": np.where(go, lowest, np.inf), "need": np.where(go | (size[own] <= cap), np.inf, lowest)})

    asked = materialize(rows.mapInPandas(run, "id long, shard int, to int, gain double, need double"), "asked")
    leave = F.row_number().over(Window.partitionBy("shard").orderBy("gain", "id"))
    enter = F.row_number().over(Window.partitionBy("to").orderBy("gain", "id"))
    excess = F.create_map(*[F.lit(x) for s, n in enumerate(size) for x in (s, int(max(0, n - cap)))])
    room = F.create_map(*[F.lit(x) for s, n in enumerate(size) for x in (s, int(max(0, cap - n)))])
    may = (F.col("out") <= excess[F.col("shard")]) & (F.col("in") <= room[F.col("to")])
    going = asked.where(F.col("to") != F.col("shard")).withColumns({"out": leave, "in": enter})
    moved = going.select("id", F.when(may, F.col("to")).otherwise(F.col("shard")).alias("shard"), F.lit(None).cast("double").alias("need"))
    stays = asked.where(F.col("to") == F.col("shard")).select("id", "shard", F.when(F.col("need") <= 1e300, F.col("need")).alias("need"))
    return moved.unionByName(stays)


def hierarchical_kmeans(points: DataFrame, ratio: float = 0.02, fanout: int = 64, metric: str = "l2", rounds: int = 20, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(leaves(id, leaf), centers(leaf, vec, size)): split level by level until a node has no more points than its share of centers allows.

    A node of n points gets min(fanout, n * ratio) children; it is a leaf once n * ratio < 2 or all its points are alike. Nodes of more
    than so many values are split by all tasks, a level at a time; smaller ones with all that is below them in one task each.
    """

    def below(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        v, ids = np.stack(pdf["vec"].to_numpy()).astype(float), pdf["id"].to_numpy()
        todo, path = [(np.arange(len(ids)), list(pdf["path"].iloc[0]))], np.empty(len(ids), object)
        while todo:
            own, node = todo.pop()
            m = min(fanout, int(len(own) * ratio))
            part = kernels.lloyd(v[own], v[own][kernels.sample_rows(ids[own], m, SEED + len(node))], metric, rounds)[0] if m >= 2 else np.zeros(len(own), np.int64)
            if part.max() == 0:
                for i in own:
                    path[i] = node
            else:
                todo += [(own[part == p], [*node, int(p)]) for p in np.unique(part)]
        return pd.DataFrame({"id": ids, "path": path})

    now, done, schema = points.select("id", "vec", F.array(F.lit(0)).alias("path")), [], "id long, path array<int>"
    while now is not None:
        small, rest, sizes = split_by_size(keyed(now, "path"), "nodes", large)
        done.append(small.groupBy("node").applyInPandas(below, schema))
        now = None
        wanted = {s: (min(fanout, int(n * ratio)), SEED + s.count(".") + 1) for s, n in sizes.items()}
        wanted = {s: how for s, how in wanted.items() if how[0] >= 2}
        if wanted:
            placed, made = node_kmeans(rest, wanted, metric, rounds)
            whole = [s for s, (at, _) in made.items() if len(at) == 1]
            ended = F.col("node").isin([*whole, *(sizes.keys() - wanted.keys())])
            done.append(rest.where(ended).select("id", "path"))
            if len(whole) < len(wanted):
                now = placed.where(~ended).select("id", "vec", F.concat("path", F.array(F.col("part"))).alias("path"))
        elif rest is not None:
            done.append(rest.select("id", "path"))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    whole = materialize(whole, "paths")
    names = whole.select("path").distinct().withColumn("leaf", (F.row_number().over(Window.orderBy("path")) - 1).cast("int"))
    leaves = whole.join(names, "path").select("id", "leaf")
    at = centers(points, leaves.select("id", F.col("leaf").alias("shard")), metric)
    sizes = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    return leaves, at.select(F.col("shard").alias("leaf"), "vec").join(sizes, "leaf")
