"""Best-fit packing of documents into bins of fixed capacity, under conflicts.

A document longer than a bin is cut into full pieces, which fill bins of their own, and a rest. Pieces are packed longest
first. Open bins are kept in order of their residual space. Each carries two bitmaps: the sources and the duplicate clusters
that it holds. From the tightest bin that fits, the search goes on to the next larger residual until a bin is compatible:
it holds no piece of the same duplicate cluster, and fewer than the allowed pieces of the source.

Documents are dealt by hash to shards of bounded size, each packed by itself; so a hot source or cluster is spread evenly.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable
from dataclasses import dataclass, field
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE


@dataclass
class Bin:
    number: int
    residual: int
    sources: int = 0  # bit k: source k of the shard is in
    full_sources: int = 0  # bit k: source k has as many pieces as it may
    clusters: int = 0  # bit k: cluster k of the shard is in
    per_source: dict[int, int] = field(default_factory=dict)


def pack(pieces: Iterable[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, place in the bin) of each piece (length, source, cluster), given longest first.

    source and cluster are small numbers, or -1 for none, which never conflicts. Each length is at most capacity.
    """
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    bins: list[Bin] = []
    out = []
    for length, source, cluster in pieces:
        s, c = (1 << source) if source >= 0 else 0, (1 << cluster) if cluster >= 0 else 0
        at = bisect_left(order, (length, -1))
        while at < len(order) and (bins[order[at][1]].full_sources & s or bins[order[at][1]].clusters & c):
            at += 1
        if at < len(order):
            b = bins[order.pop(at)[1]]
        else:
            b = Bin(len(bins), capacity)
            bins.append(b)
        out.append((b.number, capacity - b.residual))
        b.residual -= length
        b.sources |= s
        b.clusters |= c
        if source >= 0:
            b.per_source[source] = b.per_source.get(source, 0) + 1
            if b.per_source[source] >= per_source:
                b.full_sources |= s
        if b.residual > 0:
            insort(order, (b.residual, b.number))
    return out


def _shard(capacity: int, per_source: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["length", "id", "source", "cluster"], ascending=[False, True, True, True], kind="stable")
        source, cluster = (pd.factorize(rows[c])[0] for c in ("source", "cluster"))
        full = [(int(n) // capacity) if n else 0 for n in rows["length"]]
        rest = [(k, int(n) - f * capacity) for k, (n, f) in enumerate(zip(rows["length"], full, strict=True))]
        rest = sorted((x for x in rest if x[1] > 0 or not full[x[0]]), key=lambda x: -x[1])
        placed = pack(((n, int(source[k]), int(cluster[k])) for k, n in rest), capacity, per_source)
        ids, shard, used = rows["id"].tolist(), int(rows["shard"].iloc[0]), max((b for b, _ in placed), default=-1) + 1
        out = []
        for k, f in enumerate(full):
            for piece in range(f):
                out.append((ids[k], piece, piece * capacity, capacity, shard, used, 0))
                used += 1
        for (k, n), (b, at) in zip(rest, placed, strict=True):
            out.append((ids[k], full[k], full[k] * capacity, n, shard, b, at))
        made = pd.DataFrame(out, columns=["id", "piece", "start", "n_words", "shard", "bin", "place"])
        made["id"] = made["id"].astype("Int64")
        return made

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: str | None = None, capacity: int = 2048, per_source: int = 4, shard_rows: int = 4000) -> DataFrame:
    """(id, piece, start, n_words, shard, bin, place): where each piece of each document lies.

    Lengths are counted in words (runs of characters other than \\x20 and \\x09-\\x0D). A piece has the words start to start +
    n_words of its text, and lies at word place of bin (shard, bin). cluster names the column of the duplicate cluster; by default exact copies
    are one cluster. No bin holds two documents of a cluster, nor more than per_source documents of a source. Full pieces of long
    documents have bins of their own.
    Null and empty texts have one piece of 0 words. Null sources and clusters never conflict. Each row is packed by itself, also
    if rows repeat an id or the id is null. An empty table gives an empty result.
    Shards hold shard_rows rows on average, however many rows there are and however alike they are: rows are dealt by hash of their place in
    the table and of their id. So docs should be read from files; rows that come from a shuffle have no fixed place.
    """
    text = F.col(f"`{text_col}`")
    gap = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    words = F.when(gap == "", 0).otherwise(F.size(F.split(gap, SPACE)))
    n_shards = max(1, ceil(docs.count() / shard_rows))
    lean = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), words.cast("long").alias("length"),
        (F.col(f"`{cluster}`").cast("string") if cluster else F.when(gap != "", F.md5(text))).alias("cluster"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.col(f"`{id_col}`")), F.lit(n_shards)).alias("shard"),
    )
    made = lean.groupBy("shard").applyInPandas(_shard(capacity, per_source), "id long, piece long, start long, n_words long, shard long, bin long, place long")
    return made.withColumnRenamed("id", id_col)
