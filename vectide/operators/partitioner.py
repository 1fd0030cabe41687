"""Balanced graph partitioning with few cut edges: coarsening, an initial partition, refinement under a size cap."""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .shards import hash_order

COARSE = 4_000  # nodes that the driver partitions, give or take a few for each shard


def partition_graph(edges: DataFrame, nodes: DataFrame, k: int, epsilon: float = 0.05, rounds: int = 6, seed: int = 555) -> DataFrame:
    """(id, shard): k shards of total node weight at most (1 + epsilon) n / k each (one node more where nodes are heavy).

    edges(src, dst, weight) are symmetric; nodes(id, weight). Clusters of label propagation with a weight limit are contracted until few
    nodes are left; those are partitioned on the driver; then labels are projected back, and nodes move to the neighbouring shard with
    the heaviest edges as far as it has room, half of them at a time.
    """
    total = nodes.agg(F.sum("weight")).first()[0] or 0
    if not total:
        return nodes.select("id", F.lit(0).alias("shard"))
    cap = max(ceil(total / k), int((1 + epsilon) * total / k))
    levels, now_edges, now_nodes, n = [], edges, nodes, nodes.count()
    while n > COARSE:
        label = _coarsen(now_edges, now_nodes, max(1, min(cap // 4, 4 * total // COARSE)), seed + len(levels))
        up = label.select(F.col("id"), F.col("label"))
        coarse = materialize(now_nodes.join(up, "id").groupBy(F.col("label").alias("id")).agg(F.sum("weight").alias("weight")), "coarse")
        fewer = coarse.count()
        if fewer > 0.9 * n:  # edges don't lead on, as with isolated nodes: put nodes together by weight
            label = _bundled(now_nodes.join(up, "id").select("id", "label", "weight"), coarse, max(2, min(cap // 4, 4 * total // COARSE)))
            up = label.select("id", "label")
            coarse = materialize(now_nodes.join(up, "id").groupBy(F.col("label").alias("id")).agg(F.sum("weight").alias("weight")), "coarse")
            if coarse.count() >= n:
                break  # no two nodes fit together: there are no more nodes than a few for each shard
            fewer = coarse.count()
        a, b = up.select(F.col("id").alias("src"), F.col("label").alias("s")), up.select(F.col("id").alias("dst"), F.col("label").alias("t"))
        levels.append((up, now_edges, now_nodes))
        now_edges = materialize(now_edges.join(a, "src").join(b, "dst").where("s <> t").groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.sum("weight").alias("weight")), "contracted")
        now_nodes, n = coarse, fewer
    shard = _initial(now_edges, now_nodes, k, cap)
    for up, fine_edges, fine_nodes in reversed(levels):
        shard = up.join(shard.select(F.col("id").alias("label"), "shard"), "label").select("id", "shard")
        shard = refine(fine_edges, fine_nodes, shard, cap, rounds, seed)
    return shard


def _bundled(labels: DataFrame, coarse: DataFrame, limit: int) -> DataFrame:
    """(id, label): labels whose weights together are about limit are made one, in slices by hash of some thousand labels."""
    slices = max(1, ceil(coarse.count() / 10_000))
    sliced = coarse.select(F.col("id").alias("label"), "weight", F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice"))
    so_far = F.sum("weight").over(Window.partitionBy("slice").orderBy("weight", "label"))
    binned = sliced.withColumn("bin", F.floor((so_far - F.col("weight")) / F.lit(limit)))
    one = binned.withColumn("to", F.min("label").over(Window.partitionBy("slice", "bin"))).select("label", "to")
    return materialize(labels.join(one, "label").select("id", F.col("to").alias("label")), "bundled")


def _coarsen(edges: DataFrame, nodes: DataFrame, limit: int, seed: int, rounds: int = 3) -> DataFrame:
    """(id, label): clusters of at most limit weight (or one node)."""
    label = nodes.select("id", "weight", F.col("id").alias("label"))
    for r in range(rounds):
        of = label.select(F.col("id").alias("dst"), F.col("label").alias("to"))
        best = edges.join(of, "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("weight").alias("w"))
        first = F.min(F.struct(-F.col("w"), hash_order(seed + r, "to"), "to"))
        best = best.groupBy("id").agg(first.alias("first")).select("id", F.col("first.to").alias("to"))
        sizes = label.groupBy("label").agg(F.sum("weight").alias("held")).withColumnRenamed("label", "to")
        turn = F.pmod(hash_order(seed + r, "id"), F.lit(2)) == r % 2
        asked = label.join(best, "id").where(turn & (F.col("to") != F.col("label"))).join(sizes, "to")
        so_far = F.sum("weight").over(Window.partitionBy("to").orderBy(hash_order(seed, "id"), "id"))
        go = asked.withColumn("all", so_far + F.col("held")).where(F.col("all") <= limit).select("id", "to")
        label = materialize(label.join(go, "id", "left").select("id", "weight", F.coalesce("to", "label").alias("label")), "labels")
    return label


def refine(edges: DataFrame, nodes: DataFrame, shard: DataFrame, cap: int, rounds: int, seed: int) -> DataFrame:
    """Nodes move to the shard that most of their edge weight leads to, best gains first, while it has room."""
    now = materialize(shard, "shards")
    for r in range(rounds):
        of = now.select(F.col("id").alias("dst"), F.col("shard").alias("to"))
        pull = edges.join(of, "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("weight").alias("w"))
        own = pull.join(now, "id")
        here = F.coalesce(F.max(F.when(F.col("to") == F.col("shard"), F.col("w"))), F.lit(0)).alias("here")
        first = F.min(F.struct((-F.col("w")).alias("w"), "to")).alias("first")
        best = own.where(F.pmod(hash_order(seed, "id"), F.lit(2)) == r % 2).groupBy("id", "shard").agg(first, here)
        best = best.select("id", "shard", F.col("first.to").alias("to"), (-F.col("first.w") - F.col("here")).alias("gain"))
        best = best.where("to <> shard and gain > 0").drop("shard").join(nodes, "id")
        held = now.join(nodes, "id").groupBy(F.col("shard").alias("to")).agg(F.sum("weight").alias("held"))
        so_far = F.sum("weight").over(Window.partitionBy("to").orderBy(F.desc("gain"), "id"))
        go = best.join(F.broadcast(held), "to").withColumn("all", so_far + F.col("held")).where(F.col("all") <= cap).select("id", "to")  # one row for each shard
        now = materialize(now.join(go, "id", "left").select("id", F.coalesce("to", "shard").alias("shard")), "shards")
    return now


def _initial(edges: DataFrame, nodes: DataFrame, k: int, cap: int) -> DataFrame:
    """On the driver, for a bounded number of nodes: grow shards from far seeds, then move nodes while the cut shrinks."""
    rows = sorted((r["id"], r["weight"]) for r in nodes.collect())
    place = {i: p for p, (i, _) in enumerate(rows)}
    weight = np.array([w for _, w in rows])
    near: list[dict[int, int]] = [{} for _ in rows]
    for r in edges.collect():
        if r["src"] in place and r["dst"] in place:
            near[place[r["src"]]][place[r["dst"]]] = r["weight"]
    shard = grow_and_move(near, weight, k, cap)
    schema = f"id {dict(nodes.dtypes)['id']}, shard int"
    return nodes.sparkSession.createDataFrame([(i, int(shard[p])) for p, (i, _) in enumerate(rows)], schema)


def grow_and_move(near: list[dict[int, int]], weight: np.ndarray, k: int, cap: int, passes: int = 12) -> np.ndarray:
    n = len(near)
    shard, room = np.full(n, -1), np.full(k, cap, float)
    order = list(np.argsort([-len(x) for x in near], kind="stable"))
    aim = weight.sum() / k
    for s in range(k):
        seeds = [p for p in order if shard[p] < 0]
        if not seeds:
            break
        pull: dict[int, int] = {seeds[-1]: 0}
        heap = [(0, seeds[-1])]  # of pulls, outdated ones included
        while heap and cap - room[s] < aim:
            w, p = heapq.heappop(heap)
            if pull.get(p) != -w:
                continue
            del pull[p]
            if shard[p] < 0 and weight[p] <= room[s]:
                shard[p] = s
                room[s] -= weight[p]
                for q, w in near[p].items():
                    if shard[q] < 0:
                        pull[q] = pull.get(q, 0) + w
                        heapq.heappush(heap, (-pull[q], q))
            if not pull and cap - room[s] < aim:
                more = next((x for x in order if shard[x] < 0 and weight[x] <= room[s]), None)
                if more is not None:
                    pull, heap = {more: 0}, [(0, more)]
    for p in sorted((x for x in range(n) if shard[x] < 0), key=lambda x: -weight[x]):
        gain = np.zeros(k)
        for q, w in near[p].items():
            if shard[q] >= 0:
                gain[shard[q]] += w
        fits = room >= weight[p]
        s = int(np.argmax(np.where(fits, gain + room / (cap * n + 1), -1))) if fits.any() else int(room.argmax())
        shard[p] = s
        room[s] -= weight[p]
    for _ in range(passes):
        moved = False
        for p in range(n):
            gain = np.zeros(k)
            for q, w in near[p].items():
                gain[shard[q]] += w
            here = gain[shard[p]]
            gain[room < weight[p]] = -1
            gain[shard[p]] = here
            s = int(gain.argmax())
            if gain[s] > here:
                room[shard[p]] += weight[p]
                room[s] -= weight[p]
                shard[p], moved = s, True
        if not moved:
            break
    return shard
