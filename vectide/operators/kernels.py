"""Exact numpy kernels over blocks of vectors; nothing here knows Spark."""

from __future__ import annotations

import numpy as np

PAIRS = 65_536  # summed anew at a time


def distances(points: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """From each point, summed row by row, so that equal vectors get equal values wherever they stand."""
    if metric == "l2":
        diff = points - query
        return (diff * diff).sum(axis=1)
    return 1.0 - (points * query).sum(axis=1)


def pairwise(points: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """As distances, row against row."""
    if metric == "l2":
        diff = points - queries
        return (diff * diff).sum(axis=1)
    return 1.0 - (points * queries).sum(axis=1)


def matrix(points: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distances by matrix product, right up to rounding: one row for each query."""
    product = queries @ points.T
    if metric == "mips":
        return 1.0 - product
    return (queries * queries).sum(axis=1)[:, None] - 2 * product + (points * points).sum(axis=1)[None, :]


def top_k(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str, exclude_self: bool = False, step: int = 256):
    """(query, id, distance) of each query's k nearest, ties to the smaller id.

    The matrix product only narrows the choice: what lies within rounding of the k-th is computed anew.
    """
    out = []
    scale = 1e-9 * (1.0 + float(np.abs(points).max(initial=0.0)) * float(np.abs(queries).max(initial=0.0)) * points.shape[1])
    for at in range(0, len(queries), step):
        some, of = query_ids[at : at + step], queries[at : at + step]
        rough = matrix(points, of, metric)
        if exclude_self:
            rough[some[:, None] == ids[None, :]] = np.inf
        m = min(k, len(ids))
        if not m:
            continue
        row, near = np.nonzero((rough <= np.partition(rough, m - 1, axis=1)[:, m - 1, None] + scale) & np.isfinite(rough))
        exact = np.empty(len(row))
        for a in range(0, len(row), PAIRS):  # copies may all be as near as the k-th
            s = slice(a, a + PAIRS)
            exact[s] = pairwise(points[near[s]], of[row[s]], metric)
        order = np.lexsort((ids[near], exact, row))
        row, near, exact = row[order], near[order], exact[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((some[row[best]], ids[near[best]], exact[best]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest_center(points: np.ndarray, centers: np.ndarray, metric: str, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of each point's nearest center, ties to the lower index.

    As in top_k, the matrix product only narrows the choice.
    """
    index, best = np.empty(len(points), np.int64), np.empty(len(points))
    step = max(1, min(step, 4_000_000 // max(1, len(centers))))
    for at in range(0, len(points), step):
        p = points[at : at + step]
        rough = matrix(centers, p, metric)
        scale = 1e-9 * (1.0 + float(np.abs(p).max(initial=0.0)) * float(np.abs(centers).max(initial=0.0)) * p.shape[1])
        row, c = np.nonzero(rough <= rough.min(axis=1)[:, None] + scale)
        if metric == "l2":
            diff = p[row] - centers[c]
            d = (diff * diff).sum(axis=1)
        else:
            d = 1.0 - (p[row] * centers[c]).sum(axis=1)
        order = np.lexsort((c, d, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        index[at : at + step], best[at : at + step] = c[first], d[first]
    return index, best


def means(points: np.ndarray, cluster: np.ndarray, k: int, metric: str) -> np.ndarray:
    """Centers of k clusters; rows of NaN where a cluster is empty.

    Under mips: the direction of the sum of unit vectors, as long as the root of the mean squared norm.
    """
    out = np.full((k, points.shape[1]), np.nan)
    for c in np.unique(cluster):
        own = points[cluster == c]
        if metric == "l2":
            out[c] = own.mean(axis=0)
        else:
            norms = np.sqrt((own * own).sum(axis=1))
            total = (own / np.where(norms > 0, norms, 1)[:, None]).sum(axis=0)
            length = np.sqrt((total * total).sum())
            out[c] = total / (length or 1) * np.sqrt((norms * norms).mean())
    return out


def lloyd(points: np.ndarray, centers: np.ndarray, metric: str, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(assignment, centers) after so many rounds. The assignment is that of the last round, one step behind the centers."""
    cluster = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        cluster, _ = nearest_center(points, centers, metric)
        new = means(points, cluster, len(centers), metric)
        full = ~np.isnan(new[:, 0])
        cluster = (np.cumsum(full) - 1)[cluster]
        centers = new[full]
    return cluster, centers


def sample_order(ids: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each id, in whose order rows are sampled."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B9 + 1) % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def sample_rows(ids: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Positions of m rows, or all: the smallest in a hash order of ids, in ascending order."""
    return np.sort(np.lexsort((ids, sample_order(ids, seed)))[:m])
