"""Approximate nearest neighbours by inner product: multi-index hashing over learned rotated binary codes.

Vectors get a further component that makes them all as long as the longest, queries get 0 there; then the largest inner product
is the smallest angle. Rotations of the principal axes (iterative quantisation) are fitted on a bounded sample; the signs of the
rotated components are the code. Codes are split into substrings, each indexed. By the pigeonhole principle, a code within radius r of the
query's agrees with it in some substring up to a fraction of r, so probing every substring's index for all values that near retrieves
every code within the radius. What is retrieved and lies within it is reranked by inner products in double precision.

The radius holds a stated share of the true neighbours of some sampled queries among all rows, so it fits tables of any size. A query
that has too few codes within it is asked again with the largest radius, which holds all rows.

Vectors without a strong structure have their neighbours far away, beyond a third of the code. Values that near of a short
substring are nearly all values. So substrings are long here, and an index is probed by comparing its values, not by listing near ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 4096  # vectors that the rotations are fitted on
ASKED = 128  # queries that the radius is fitted on
BITS = 512
SUBSTRINGS = 2
BLOCK = 32_768  # vectors of a block of rows, and of a block of queries


@dataclass
class Codes:
    turn: np.ndarray  # (d + 1) x bits
    longest: float
    radius: int = BITS

    def encode(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Rows of 64-bit words."""
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = vectors / self.longest
            more = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0))
            return np.packbits(np.column_stack([scaled, more]) @ self.turn > 0, axis=1).view(np.uint64)


def fit_codes(sample: np.ndarray, longest: float, bits: int = BITS, rounds: int = 20, seed: int = 555) -> Codes:
    """As many rotations as bits need, each from a random start of its own."""
    scaled = sample / longest
    x = np.column_stack([scaled, np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0))])
    values, axes = np.linalg.eigh(x.T @ x)
    base = axes[:, np.argsort(-values, kind="stable")[:bits]]
    v, rng, turns = x @ base, np.random.default_rng(seed), []
    for _ in range(ceil(bits / base.shape[1])):
        turn = np.linalg.qr(rng.normal(size=(base.shape[1], base.shape[1])))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        turns.append(base @ turn)
    return Codes(np.concatenate(turns, axis=1)[:, :bits], longest, bits)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each of b's codes from each of a's."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w][:, None] ^ b[:, w][None, :])
    return out


class Index:
    """Multi-index over the codes of a block: of each substring the values, and the rows that have them."""

    def __init__(self, codes: np.ndarray, substrings: int = SUBSTRINGS):
        self.codes, self.each = codes, codes.shape[1] // substrings
        self.substrings = substrings
        self.touched = 0  # codes that probes retrieved

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all codes within the Hamming radius of each of the asked ones."""
        share, extra = divmod(radius, self.substrings)
        hit, total = np.zeros((len(asked), len(self.codes)), bool), np.zeros((len(asked), len(self.codes)), np.uint16)
        for s in range(self.substrings):
            words = slice(s * self.each, (s + 1) * self.each)
            near = hamming(asked[:, words], self.codes[:, words])
            if (r := share if s <= extra else share - 1) >= 0:
                hit |= near <= r
            total += near
        self.touched += int(hit.sum())
        return np.nonzero(hit & (total <= radius))


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, codes: Codes, k: int, step: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k nearest within the radius for each query; ties to the smaller id."""
    index, asked = Index(codes.encode(vectors)), codes.encode(queries, query=True)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at in range(0, len(queries), step):
        q, row = index.within(asked[at : at + step], codes.radius)
        q += at
        other = ids[row] != query_ids[q]
        q, row = q[other], row[other]
        scores = np.concatenate([(vectors[row[c : c + BLOCK]] * queries[q[c : c + BLOCK]]).sum(axis=1) for c in range(0, len(q), BLOCK)] or [np.empty(0)])
        order = np.lexsort((ids[row], -scores, q))
        q, row, scores = q[order], row[order], scores[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((query_ids[q[best]], ids[row[best]], scores[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector without nulls, NaN and infinite components, not all zero."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lengths(every: int):
    """Of each batch and length of vectors: rows, queries, and the largest norm (squares may be beyond doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes = b.column(0).to_numpy(zero_copy_only=False), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            rows = []
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                v = _matrix(b.column(1).take(pa.array(own)))
                most = np.abs(v).max(axis=1)
                rows.append((int(d), len(own), int((ids[own] % every == 0).sum()), float((most * np.sqrt(((v / most[:, None]) ** 2).sum(axis=1))).max())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.float64()))], names=["d", "n", "q", "longest"])

    return run


def fit_radius(rows: DataFrame, asked: list, codes: Codes, k: int, recall: float) -> int:
    """The radius that holds that share of the k nearest of the asked rows among all rows; each partition sends k rows for each."""
    sent = rows.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in asked]), np.array([r["v"] for r in asked], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = sent.value
        mine = codes.encode(queries, query=True)
        for b in batches:
            if b.num_rows:
                ids, v = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1))
                score, far = queries @ v.T, hamming(mine, codes.encode(v))
                score[query_ids[:, None] == ids[None, :]] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                q = np.repeat(np.arange(len(queries)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, score[q, best.ravel()], far[q, best.ravel()].astype(np.int64))], names=["q", "score", "far"])

    found = rows.select("id", "v").mapInArrow(run, "q long, score double, far long").where(F.col("score") > float("-inf"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "far"))
    far = [r["far"] for r in found.withColumn("place", place).where(F.col("place") <= k).select("far").collect()]
    sent.destroy()
    return int(np.quantile(far, recall, method="higher")) if far else codes.radius


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, bits: int = BITS, recall: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by every, the k nearest other rows found.

    bits: a multiple of 64 * SUBSTRINGS. recall: the share of true neighbours that the radius is to hold. Ties go to the smaller id.
    Rows with a null id or vector, or a vector that is all zero or holds nulls or non-finite components, take no part. Vectors of
    different lengths have no inner product: those of each length are searched among themselves. Rows that repeat an id are no
    candidates of each other, and a row's repeats are one candidate; a query id that repeats is asked once. An empty table gives an empty result;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vector_col)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    counted = good.mapInArrow(_lengths(every), "d int, n long, q long, longest double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.max("longest").alias("longest"))
    for r in counted.orderBy("d").collect():  # one row for each length of vectors
        if r["q"]:
            out = out.union(_of_length(good.where(F.size("v") == r["d"]), r["n"], r["q"], r["longest"], every, k, bits, recall))
    return out


def _of_length(good: DataFrame, n: int, n_asked: int, longest: float, every: int, k: int, bits: int, recall: float) -> DataFrame:
    sample = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    codes = fit_codes(np.array([r["v"] for r in sample]), longest, bits)
    codes.radius = fit_radius(good, sample[:ASKED], codes, k, recall)
    queries = good.where(F.col("id") % every == 0).dropDuplicates(["id"])
    found = materialize(_search(good, queries, n, n_asked, codes, k), "neighbours")
    few = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, n - 1)).select(F.col("query_id").alias("id"))
    again = materialize(queries.join(few, "id", "left_anti"), "again")
    if left := again.count():
        whole = _search(good, again, n, left, Codes(codes.turn, codes.longest, bits), k)
        found = found.join(again.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
    return found.select("query_id", "rank", "vec_id", "score")


def _search(good: DataFrame, queries: DataFrame, n: int, n_asked: int, codes: Codes, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): each block of rows meets each block of queries in a task; k rows for each query leave it."""
    cores = good.sparkSession.sparkContext.defaultParallelism
    blocks, asked = max(ceil(n / BLOCK), min(2 * cores, ceil(n / 2048))), max(1, ceil(n_asked / BLOCK))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    rows = good.select("id", "v", F.lit(False).alias("ask"), dealt(blocks, 0).alias("b"), numbers(asked).alias("a"))
    both = rows.unionByName(queries.select("id", "v", F.lit(True).alias("ask"), numbers(blocks).alias("b"), dealt(asked, 1).alias("a")))

    def run(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy()
        ids, v = table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks())
        found = search_block(ids[~ask], v[~ask], ids[ask], v[ask], codes, k) if ask.any() and not ask.all() else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    found = both.groupBy("a", "b").applyInArrow(run, "query_id long, vec_id long, score double").distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)
