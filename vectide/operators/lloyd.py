"""Lloyd's rounds over partitions: for one set of centers, or for many nodes of a tree at once, each with centers of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from . import kernels
from .neighbours import as_matrix

LARGE = 8_000_000  # values in the vectors of a node that one task may hold; nodes beyond are clustered by all tasks
CENTER_VALUES = 8_000_000  # values in the centers that go to executors at a time

Spans = dict[str, tuple[int, int]]  # where the centers of each node stand among all


def grouped(keys: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Each key with the rows that have it."""
    names, of = np.unique(keys.astype(str), return_inverse=True)
    order = np.argsort(of, kind="stable")
    for name, rows in zip(names, np.split(order, np.cumsum(np.bincount(of, minlength=len(names)))[:-1]), strict=True):
        yield str(name), rows


def nearest(v: np.ndarray, keys: np.ndarray, at: np.ndarray, spans: Spans, metric: str) -> np.ndarray:
    """Place in at of each row's nearest center among those of its node; -1 if its node has none."""
    index = np.full(len(v), -1, np.int64)
    for key, rows in grouped(keys):
        if key in spans:
            lo, hi = spans[key]
            index[rows] = lo + kernels.nearest_center(v[rows], at[lo:hi], metric)[0]
    return index


def lloyd_round(points: DataFrame, at: np.ndarray, metric: str, spans: Spans | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of centers that have points, their new values, how many points each has). points(vec), or points(vec, node) with spans.

    Each partition sends k sums of d values, added up cluster by cluster.
    """
    sent = points.sparkSession.sparkContext.broadcast((at, spans))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spans = sent.value
        k, d = at.shape
        sums, counts, squares = np.zeros((k, d)), np.zeros(k), np.zeros(k)
        for b in batches:
            if not b.num_rows:
                continue
            v = as_matrix(b.column(0))
            index = kernels.nearest_center(v, at, metric)[0] if spans is None else nearest(v, b.column(1).to_numpy(zero_copy_only=False), at, spans, metric)
            if spans is not None:
                v, index = v[index >= 0], index[index >= 0]
            n2 = (v * v).sum(axis=1)
            _add(sums, index, v if metric == "l2" else v / np.sqrt(np.where(n2 > 0, n2, 1))[:, None])
            counts += np.bincount(index, minlength=k)
            squares += np.bincount(index, weights=n2, minlength=k)
        used = np.flatnonzero(counts)
        yield _sums(used, sums[used], counts[used], squares[used])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = sent.value[0].shape
        sums, counts, squares = np.zeros((k, d)), np.zeros(k), np.zeros(k)
        for b in batches:
            if b.num_rows:
                c, n, q = (b.column(x).to_numpy(zero_copy_only=False) for x in (0, 2, 3))
                _add(sums, c, as_matrix(b.column(1)))
                np.add.at(counts, c, n)
                np.add.at(squares, c, q)
        used = np.flatnonzero(counts)
        yield _sums(used, sums[used], counts[used], squares[used])

    schema = "c long, s array<double>, n double, q double"
    columns = [F.col("vec").cast("array<double>").alias("vec"), *(["node"] if spans is not None else [])]
    parts = points.select(*columns).mapInArrow(partial, schema)
    rows = sorted(parts.repartition("c").mapInArrow(total, schema).collect(), key=lambda r: r["c"])
    sent.destroy()
    out = []
    for r in rows:
        s = np.array(r["s"])
        out.append(s / r["n"] if metric == "l2" else s / (np.sqrt((s * s).sum()) or 1) * np.sqrt(r["q"] / r["n"]))
    return np.array([r["c"] for r in rows], np.int64), np.array(out), np.array([r["n"] for r in rows], np.int64)


def _add(sums: np.ndarray, index: np.ndarray, v: np.ndarray) -> None:
    """sums[index] += v, where an index may repeat."""
    order = np.argsort(index, kind="stable")
    c, first = np.unique(index[order], return_index=True)
    if len(c):
        sums[c] += np.add.reduceat(v[order], first, axis=0)


def _sums(c: np.ndarray, s: np.ndarray, n: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(list(s), pa.list_(pa.float64())), pa.array(n), pa.array(q)], names=["c", "s", "n", "q"])


# ---- many nodes at once ----------------------------------------------------------------------------------------------


def large_nodes(rows: DataFrame, bound: int) -> dict[str, int]:
    """Points of each node of rows(node, vec) whose vectors hold more than so many values."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vec")).alias("values"))
    return {r["node"]: r["n"] for r in sizes.where(F.col("values") > bound).collect()}


def _starts(rows: DataFrame, wanted: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
    """The rows that kernels.sample_rows picks of each node, in the order of ids. Partitions send no more than a node wants."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.DataFrame] = {}
        for pdf in batches:
            for key, at in grouped(pdf["node"].to_numpy()):
                if key in wanted:
                    m, seed = wanted[key]
                    own = pd.concat([held[key], pdf.iloc[at]]) if key in held else pdf.iloc[at]
                    held[key] = own.iloc[kernels.sample_rows(own["id"].to_numpy(), m, seed)]
        for key, own in held.items():
            yield own.assign(h=kernels.sample_order(own["id"].to_numpy(), wanted[key][1]))

    some = rows.select("node", F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).mapInPandas(pick, "node string, id long, vec array<double>, h long")
    most = max(m for m, _ in wanted.values())
    first = some.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("h", "id", "vec"))).where(F.col("r") <= most)
    out: dict[str, list] = {}
    for r in first.collect():
        if r["r"] <= wanted[r["node"]][0]:
            out.setdefault(r["node"], []).append((r["id"], r["vec"]))
    return {key: np.array([v for _, v in sorted(own)]) for key, own in out.items()}


def node_kmeans(rows: DataFrame, wanted: dict[str, tuple[int, int]], metric: str, rounds: int) -> tuple[DataFrame, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """(rows with part, (centers, sizes) of each node): k-means in each node of rows(node, id, vec, ...) that is wanted: (clusters, seed).

    The same as kernels.lloyd of a node's rows in the order of ids, up to the rounding of sums, with all tasks at work on all nodes.
    Other nodes' rows are left out. Nodes whose centers are too many to be sent at once take turns.
    """
    turns, now, held = [], {}, 0
    width = rows.select(F.max(F.size("vec"))).first()[0] or 1
    for key, (m, seed) in sorted(wanted.items()):
        if now and held + m * width > CENTER_VALUES:
            turns, now, held = [*turns, now], {}, 0
        now[key], held = (m, seed), held + m * width
    out, made = None, {}
    for turn in [*turns, now]:
        own = rows.where(F.col("node").isin(list(turn)))
        starts = _starts(own, turn)
        at, spans = np.concatenate([starts[key] for key in turn]), {}
        for key in turn:
            lo = max((hi for _, hi in spans.values()), default=0)
            spans[key] = (lo, lo + len(starts[key]))
        for _ in range(rounds):
            before, spans_before = at, spans
            used, at, counts = lloyd_round(own, before, metric, spans_before)
            spans = {key: tuple(int(x) for x in np.searchsorted(used, span)) for key, span in spans_before.items()}
        made |= {key: (at[lo:hi], counts[lo:hi]) for key, (lo, hi) in spans.items()}
        to = np.zeros(len(before), np.int64)
        for lo, hi in spans.values():
            to[used[lo:hi]] = np.arange(hi - lo)
        placed = own.mapInPandas(_place(own, before, spans_before, to, metric), ", ".join(f"`{c}` {kind}" for c, kind in [*own.dtypes, ("part", "int")]))
        out = placed if out is None else out.unionByName(placed)
    return out, made


def _place(rows: DataFrame, at: np.ndarray, spans: Spans, to: np.ndarray, metric: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    sent = rows.sparkSession.sparkContext.broadcast((at, spans, to))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, spans, to = sent.value
        for pdf in batches:
            if len(pdf):
                index = nearest(np.stack(pdf["vec"].to_numpy()).astype(float), pdf["node"].to_numpy(), at, spans, metric)
                yield pdf.assign(part=to[index].astype(np.int32))

    return run


def keyed(rows: DataFrame, *names: str) -> DataFrame:
    """rows with node, a text key of the named columns."""
    parts = [F.concat_ws(".", F.col(c).cast("array<string>")) if dict(rows.dtypes)[c].startswith("array") else F.col(c).cast("string") for c in names]
    return rows.withColumn("node", F.concat_ws("/", *parts))


def split_by_size(rows: DataFrame, name: str, bound: int) -> tuple[DataFrame, DataFrame | None, dict[str, int]]:
    """(rows of small nodes, rows of large ones or None, sizes of large nodes) of rows(node, id, vec, ...), written once."""
    rows = materialize(rows, name)
    large = large_nodes(rows, bound)
    is_large = F.col("node").isin(list(large))
    return (rows.where(~is_large), rows.where(is_large), large) if large else (rows, None, {})
