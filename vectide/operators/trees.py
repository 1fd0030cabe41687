"""K-means trees for routing, and navigable graphs for search within shards."""

from __future__ import annotations

import heapq
import time
from dataclasses import dataclass
from functools import partial
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from . import kernels
from .lloyd import LARGE, keyed, node_kmeans, split_by_size
from .neighbours import dedup_neighbours, rank_within


@dataclass(frozen=True)
class TreeOptions:
    num_centroids: int = 64
    min_cluster_size: int = 250
    budget: int = 50_000
    search_budget: int = 50_000
    rounds: int = 20
    seed: int = 555


def _below(shard: int, node: int, centroid: int) -> int:
    """The number of the node below a centroid: a hash of the path, so that it doesn't depend on where a node is trained."""
    x = (node * 0x9E3779B97F4A7C15 + (shard + 1) * 0xD6E8FEB86659FD93 + centroid + 1) % 2**64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return (x ^ (x >> 31)) >> 1


def _children(shard: int, node: int, budget: int, sizes: np.ndarray, how: TreeOptions) -> dict[int, tuple[int, int]]:
    """Of the centroids of a node, those that are split again: (node below, its budget)."""
    left = budget - len(sizes)
    deep = [c for c in range(len(sizes)) if sizes[c] > how.min_cluster_size] if left > 0 and len(sizes) > 1 else []
    return {c: (_below(shard, node, c), max(1, int(left * int(sizes[c]) / int(sizes[deep].sum())))) for c in deep}


def train_trees(points: DataFrame, assignment: DataFrame, how: TreeOptions, metric: str = "l2", large: int = LARGE) -> DataFrame:
    """(shard, node, centroid, vec, child): a tree for each shard; child is the node below a centroid, or null.

    Shards share the budget of centroids by size. The root is node 0; others are numbered by a hash of their path. Nodes of more than so
    many values are clustered by all tasks, a level at a time; smaller ones with all that is below them in one task each. Centroids of
    large nodes pass through the driver, no more than the budget and a node's centroids for each of them.
    """
    sizes = {r["shard"]: r["n"] for r in assignment.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = max(1, sum(sizes.values()))
    budgets = {(s, 0): max(1, how.budget * own // n) for s, own in sizes.items()}
    schema = "shard int, node long, centroid long, vec array<double>, child long"

    def trained(budgets: dict[tuple[int, int], int]):
        def train(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            ids, v, shard, root = pdf["id"].to_numpy(), np.stack(pdf["vec"].to_numpy()).astype(float), int(pdf["shard"].iloc[0]), int(pdf["at"].iloc[0])
            rows, todo = [], [(root, np.arange(len(v)), budgets[shard, root])]
            while todo:
                node, own, budget = todo.pop()
                start = kernels.sample_rows(ids[own], max(2, min(how.num_centroids, budget)), how.seed + shard + node % 2**31)
                cluster, at = kernels.lloyd(v[own], v[own][start], metric, how.rounds)
                children = _children(shard, node, budget, np.bincount(cluster, minlength=len(at)), how)
                todo += [(below, own[cluster == c], left) for c, (below, left) in children.items()]
                rows += [(shard, node, c, x.tolist(), children[c][0] if c in children else None) for c, x in enumerate(at)]
            out = pd.DataFrame(rows, columns=["shard", "node", "centroid", "vec", "child"], dtype=object)
            return out.astype({"shard": int, "node": int, "centroid": int, "child": "Int64"})  # not by way of floats, which round numbers of nodes

        return train

    own = points.join(assignment, "id").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.col("shard").cast("int").alias("shard"))
    now, out = own.withColumn("at", F.lit(0).cast("long")), None
    while now is not None:
        small, rest, held = split_by_size(keyed(now, "shard", "at"), "nodes", large)
        made = small.groupBy("node").applyInPandas(trained(budgets), schema)
        out = made if out is None else out.unionByName(made)
        now = None
        if rest is None:
            continue
        of = {key: tuple(int(x) for x in key.split("/")) for key in held}
        placed, clusters = node_kmeans(rest, {key: (max(2, min(how.num_centroids, budgets[s, x])), how.seed + s + x % 2**31) for key, (s, x) in of.items()}, metric, how.rounds)
        rows, nxt, to = [], {}, {}
        for key, (at, counts) in clusters.items():
            s, x = of[key]
            children = _children(s, x, budgets[s, x], counts, how)
            rows += [(s, x, c, v.tolist(), children[c][0] if c in children else None) for c, v in enumerate(at)]
            for c, (below, left) in children.items():
                nxt[s, below], to[f"{key}/{c}"] = left, below
        out = out.unionByName(points.sparkSession.createDataFrame(rows, schema))
        budgets = nxt
        if nxt:
            goes = points.sparkSession.createDataFrame(list(to.items()), "path string, below long")  # a row for each child of a large node
            now = placed.withColumn("path", F.concat_ws("/", "node", "part")).join(goes, "path").select("id", "vec", "shard", F.col("below").alias("at"))
    return out


def routing_points(trees: DataFrame) -> DataFrame:
    """(id, vec, shard): all centroids of all trees."""
    key = F.xxhash64("shard", "node", "centroid")
    return trees.select(key.alias("id"), "vec", "shard")


class Forest:
    """Trees as arrays; bounded by the budget of centroids."""

    def __init__(self, rows: list):
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, list]] = {}
        by: dict[tuple[int, int], list] = {}
        for r in rows:
            by.setdefault((r["shard"], r["node"]), []).append(r)
        for key, own in by.items():
            own.sort(key=lambda r: r["centroid"])
            self.nodes[key] = (np.array([r["vec"] for r in own]), [r["child"] for r in own])
        self.shards = sorted({s for s, _ in self.nodes})

    def search(self, query: np.ndarray, budget: int, metric: str, votes: int = 0) -> tuple[dict[int, float], dict[int, int]]:
        """Best first over all trees; each scanned centroid costs one. Nearest distance by shard, and votes of the nearest centroids."""
        heap = [(-np.inf, s, 0) for s in self.shards]
        heapq.heapify(heap)
        best: dict[int, float] = {}
        near: list[tuple[float, int]] = []
        while heap and budget > 0:
            _, shard, node = heapq.heappop(heap)
            at, children = self.nodes[shard, node]
            budget -= len(at)
            d = kernels.distances(at, query, metric)
            best[shard] = min(best.get(shard, np.inf), float(d.min()))
            if votes:
                near = heapq.nsmallest(votes, [*near, *((float(x), shard) for x in d)])
            for x, child in zip(d, children, strict=True):
                if child is not None and not pd.isna(child):
                    heapq.heappush(heap, (float(x), shard, int(child)))
        counts: dict[int, int] = {}
        for _, s in near:
            counts[s] = counts.get(s, 0) + 1
        return best, counts


def query_trees(trees: DataFrame, queries: DataFrame, how: TreeOptions, metric: str = "l2", votes: int = 0) -> DataFrame:
    """(query_id, shard, min_dist, votes) of the shards that the budget reaches. Trees hold at most how.budget centroids, give or take a node for each shard."""
    forest = trees.sparkSession.sparkContext.broadcast(Forest(trees.collect()))

    def run(batches):
        for pdf in batches:
            rows = []
            for q, v in zip(pdf["query_id"], pdf["qvec"], strict=True):
                best, counts = forest.value.search(np.asarray(v, float), how.search_budget, metric, votes)
                rows += [(q, s, d, counts.get(s)) for s, d in best.items()]
            yield pd.DataFrame(rows, columns=["query_id", "shard", "min_dist", "votes"]).astype({"votes": "Int64"})

    return queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")).mapInPandas(run, "query_id long, shard int, min_dist double, votes long")


# ---- navigable graphs ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class GraphOptions:
    m: int = 32
    ef_search: int = 250
    block: int = 8192  # points of a graph; larger shards have several
    entries: int = 16


class NavigableGraph:
    """A diversified neighbour graph over a block, searched best first with a beam."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, how: GraphOptions, metric: str):
        self.ids, self.v, self.metric = ids, vectors, metric
        n = len(ids)
        rows = np.arange(n)
        q, nb, dist = kernels.top_k(rows, vectors, rows, vectors, min(2 * how.m, max(1, n - 1)), metric, exclude_self=True)
        self.near: list[set[int]] = [set() for _ in range(n)]
        start = np.searchsorted(q, rows)
        end = np.searchsorted(q, rows, side="right")
        for i in rows:
            kept: list[int] = []
            for j, d in zip(nb[start[i] : end[i]], dist[start[i] : end[i]], strict=True):
                # an edge that a kept neighbour shortcuts is left out, but half of the places go to the nearest anyway
                if len(kept) < how.m // 2 or not kept or (kernels.distances(vectors[kept], vectors[j], metric) > d).all():
                    kept.append(int(j))
                if len(kept) >= how.m:
                    break
            self.near[i].update(kept)
            for j in kept:
                self.near[j].add(int(i))
        self.links = [np.fromiter(sorted(x), np.int64, len(x)) for x in self.near]
        self.entry = np.union1d(kernels.sample_rows(ids, how.entries, 555), self._islands())

    @classmethod
    def loaded(cls, ids: np.ndarray, vectors: np.ndarray, links: list[np.ndarray], entry: np.ndarray, metric: str) -> NavigableGraph:
        """A graph that was built before."""
        self = cls.__new__(cls)
        self.ids, self.v, self.links, self.entry, self.metric = ids, vectors, links, entry, metric
        return self

    def _islands(self) -> np.ndarray:
        """One point of each connected part, so that a search can reach all of them."""
        part, firsts = np.full(len(self.ids), -1), []
        for i in range(len(self.ids)):
            if part[i] >= 0:
                continue
            firsts.append(i)
            todo, part[i] = [i], i
            while todo:
                for j in self.links[todo.pop()]:
                    if part[j] < 0:
                        part[j] = i
                        todo.append(int(j))
        return np.array(firsts, np.int64)

    def search(self, queries: np.ndarray, k: int, ef: int, step: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, distances) of each query's nearest k found with a beam of ef.

        So many queries walk at once: in each step every query looks at the neighbours of the nearest point in its beam that it hasn't
        looked at yet, until there is none.
        """
        degree = np.array([len(x) for x in self.links], np.int64)
        flat, start = np.concatenate([*self.links, np.empty(0, np.int64)]), np.cumsum(degree) - degree
        out = []
        for first in range(0, len(queries), step):
            q = queries[first : first + step]
            seen = np.zeros((len(q), len(self.ids)), bool)
            seen[:, self.entry] = True
            width = max(ef, len(self.entry))
            dist, point = np.full((len(q), width), np.inf), np.full((len(q), width), -1, np.int64)
            dist[:, : len(self.entry)] = np.stack([kernels.distances(self.v[self.entry], x, self.metric) for x in q])
            point[:, : len(self.entry)] = self.entry
            best = np.argsort(dist, axis=1, kind="stable")[:, :ef]
            dist, point = np.take_along_axis(dist, best, 1), np.take_along_axis(point, best, 1)
            fresh = np.isfinite(dist)
            while True:
                at = np.where(fresh, dist, np.inf).argmin(axis=1)
                walks = np.flatnonzero(fresh[np.arange(len(q)), at])
                if not len(walks):
                    break
                fresh[walks, at[walks]] = False
                node = point[walks, at[walks]]
                many = degree[node]
                row = np.repeat(walks, many)
                near = flat[np.arange(many.sum()) + np.repeat(start[node] - (np.cumsum(many) - many), many)]
                new = ~seen[row, near]
                row, near = row[new], near[new]
                seen[row, near] = True
                d = kernels.pairwise(self.v[near], q[row], self.metric)
                good = d < dist.max(axis=1)[row]
                row, near, d = row[good], near[good], d[good]
                if not len(row):
                    continue
                grown, of = np.unique(row, return_inverse=True)
                place = np.arange(len(row)) - np.searchsorted(row, row)
                more_d, more_p = np.full((len(grown), place.max() + 1), np.inf), np.full((len(grown), place.max() + 1), -1, np.int64)
                more_d[of, place], more_p[of, place] = d, near
                all_d, all_p = np.hstack([dist[grown], more_d]), np.hstack([point[grown], more_p])
                all_f = np.hstack([fresh[grown], np.isfinite(more_d)])
                kept = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
                dist[grown], point[grown], fresh[grown] = (np.take_along_axis(x, kept, 1) for x in (all_d, all_p, all_f))
            for d, p in zip(dist, point, strict=True):
                p, d = p[np.isfinite(d)], d[np.isfinite(d)]
                order = np.lexsort((self.ids[p], d))[:k]
                out.append((self.ids[p][order], d[order]))
        return out


def _in_blocks(points: DataFrame, how: GraphOptions) -> DataFrame:
    """(part, b, id, vec): each part's points in blocks of about how.block."""
    sizes = points.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / how.block).cast("int").alias("blocks"))
    return points.join(sizes, "part").select("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("b"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))


def graph_index(points: DataFrame, how: GraphOptions | None = None, metric: str = "l2") -> DataFrame:
    """(part, b, place, id, vec, links, entry): the graphs of points(id, vec, part), to be saved as a table and searched later.

    links are the places, within the block b of the part, of a point's neighbours; searches begin at points with entry.
    """
    how = how or GraphOptions()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        graph = NavigableGraph(pdf["id"].to_numpy(), np.stack(pdf["vec"].to_numpy()), how, metric)
        return pdf.assign(place=np.arange(len(pdf)), links=graph.links, entry=np.isin(np.arange(len(pdf)), graph.entry))

    kind = dict(points.dtypes)["part"]
    return _in_blocks(points, how).groupBy("part", "b").applyInPandas(build, f"part {kind}, b int, place long, id long, vec array<double>, links array<long>, entry boolean")


def _search_blocks(index: DataFrame, queries: DataFrame, search: partial, schema: str) -> DataFrame:
    """search(graph, query ids, query vectors), whose rows go behind the part, of each block of an index with the queries of its part."""
    kind, metric = dict(index.dtypes)["part"], search.keywords["metric"]
    blocks = index.select("part", "b").distinct()
    asked = queries.join(blocks, "part").select(F.col("part").alias("in_part"), F.col("b").alias("in_b"), F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec"))

    def run(key: tuple, own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(ask):
            own, ask = own.sort_values("place"), ask.sort_values("query_id")
            graph = NavigableGraph.loaded(own["id"].to_numpy(), np.stack(own["vec"].to_numpy()), list(own["links"]), np.flatnonzero(own["entry"].to_numpy()), metric)
            rows = [(key[0], *r) for r in search(graph, ask["query_id"].to_numpy(), np.stack(ask["qvec"].to_numpy()))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in f"part {kind}, {schema}".split(", ")])

    return index.groupBy("part", "b").cogroup(asked.groupBy("in_part", "in_b")).applyInPandas(run, f"part {kind}, {schema}")


def _hits(graph: NavigableGraph, ids: np.ndarray, vectors: np.ndarray, k: int, efs: list[int], metric: str) -> list[tuple]:
    return [(ef, q, i, d) for ef in efs for q, found in zip(ids, graph.search(vectors, k, max(ef, k)), strict=True) for i, d in zip(*found, strict=True)]


def _times(graph: NavigableGraph, ids: np.ndarray, vectors: np.ndarray, k: int, efs: list[int], repeats: int, metric: str) -> list[tuple]:
    out = []
    for ef in efs:
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            graph.search(vectors, k, max(ef, k))
            took.append((time.perf_counter() - began) / len(vectors))
        out.append((ef, median(took)))
    return out


def search_index(index: DataFrame, queries: DataFrame, k: int, efs: list[int], metric: str = "l2") -> DataFrame:
    """(ef, part, query_id, rank, neighbor_id, dist) as graph_search, over a graph_index."""
    found = _search_blocks(index, queries, partial(_hits, k=k, efs=efs, metric=metric), "ef int, query_id long, neighbor_id long, dist double")
    return rank_within(found, ["ef", "part", "query_id"], k).select("ef", "part", "query_id", "rank", "neighbor_id", "dist")


def search_times(index: DataFrame, queries: DataFrame, k: int, efs: list[int], repeats: int = 5, metric: str = "l2") -> DataFrame:
    """(ef, part, seconds): what a query(query_id, qvec, part) takes in a part: the median of so many runs over all queries, blocks added up."""
    took = _search_blocks(index, queries, partial(_times, k=k, efs=efs, repeats=repeats, metric=metric), "ef int, seconds double")
    return took.groupBy("ef", "part").agg(F.sum("seconds").alias("seconds"))


def graph_search(points: DataFrame, queries: DataFrame, k: int, efs: list[int], how: GraphOptions | None = None, metric: str = "l2") -> DataFrame:
    """(ef, part, query_id, rank, neighbor_id, dist): approximate search in each part, for several beam widths over one build.

    points(id, vec, part), queries(query_id, qvec, part). Each block of a part is a graph of its own; results of blocks are merged.
    """
    return search_index(materialize(graph_index(points, how, metric), "index"), queries, k, efs, metric)


def graph_search_all(points: DataFrame, queries: DataFrame, k: int, ef: int = 250, how: GraphOptions | None = None, metric: str = "l2") -> DataFrame:
    """(query_id, rank, neighbor_id, dist) without shards."""
    one = F.lit(0).alias("part")
    return dedup_neighbours(graph_search(points.select("id", "vec", one), queries.select("query_id", "qvec", one), k, [ef], how, metric), k)
