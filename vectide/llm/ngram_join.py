"""Exact Jaccard self-join on word shingles, and the components of its links, by signature trees.

1. Documents with the same shingle set are one representative (the smallest id).
2. A set's shingles are ordered by hash. A shingle that only one of two sets has breaks at most two pairs of neighbours in
   this order in its own set, and one in the other. So two sets of similarity t share a pair of neighbours, and it is among
   the first 2 * (1 - t) * n + 1 pairs of each: only those are posted. Unlike single shingles, such pairs are hardly ever
   shared by chance or by a passage that many documents contain. Under each posted pair, documents sorted by set size form
   runs in which neighbours may still be similar enough by size. Documents of a run are candidates of each other; they are
   kept as a star, so no pairs are emitted. Two linked documents always share a run.
3. The connected groups of candidates hold every link. In each group a signature tree is built over the members:
   nodes hold the OR of token bitmaps, size ranges, and how many tokens share bits. Dual traversal drops node pairs whose
   maximum possible overlap is too small, or whose members are all connected already; the rest is compared exactly.
   Members of large groups are grouped anew by longer runs of neighbours, by the same reasoning; groups that are still large are
   cut into blocks, and pairs of blocks are tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rows_of, text_bytes
from .components import components

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
BASE = np.uint64(0x27D4EB2F165667C5)  # of the polynomials over bytes
WIDE_SIZE = 40  # shingles of a set from which long runs are posted
PIECE = 1 << 20  # bytes of a text that are hashed at once
LONG_WORD = 256  # bytes
BITS = 2048  # of a token bitmap
LEAF = 16  # members of a leaf
FANOUT = 8  # children of an inner node
BLOCK = 1_000  # members of a block of a large group


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


class WordHash:
    """64-bit hashes of all words of a text at once: polynomials over its bytes, as differences of prefix sums."""

    def __init__(self):
        steps = np.arange(1, 257, dtype=np.uint64)
        self.letters = _mix(steps * MULTIPLIERS[0])
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self._extend(PIECE)

    def _extend(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(BASE), -1, 2**64)), np.uint64)]), dtype=np.uint64)

    def __call__(self, body: bytes) -> np.ndarray:
        """Of each run of bytes other than \\x20 and \\x09-\\x0D, with A-Z lower-cased, in order."""
        body, out, at = body.lower(), [], 0
        while len(body) - at > PIECE:  # cut long texts between words
            cut = max(body.rfind(x, at, at + PIECE) for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:
                found = [x for x in (body.find(y, at + PIECE) for y in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
                cut = min(found, default=len(body) - 1)
            out.append(self._piece(body[at : cut + 1]))
            at = cut + 1
        out.append(self._piece(body[at:]))
        return np.concatenate(out) if len(out) > 1 else out[0]

    def _piece(self, body: bytes) -> np.ndarray:
        if len(body) >= len(self.powers):
            self._extend(len(body))
        data = np.frombuffer(body, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ~self.space[data], [False]])))
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=sums[1:])
        h = _mix((sums[end] - sums[start]) * self.inverse[start])
        for k in np.flatnonzero(end - start > LONG_WORD):  # polynomials of long words could be made to collide
            h[k] = xxhash.xxh3_64_intdigest(body[start[k] : end[k]])
        return h


def shingle_set(body: bytes | None, n: int, words: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a text of 1 to n-1 words has one, of the whole sequence."""
    h = words(body) if body else np.empty(0, np.uint64)
    if not len(h):
        return h
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    mixed = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        mixed += h[k : len(h) - n + 1 + k] * (MULTIPLIERS[k % 8] + np.uint64(2 * (k // 8)))
    return np.unique(_mix(mixed))


def neighbour_runs(s: np.ndarray, percent: int, width: int) -> np.ndarray:
    """Hashes of the runs of so many neighbours that a sorted set posts.

    A shingle that only this set has breaks at most width of its runs, one that only the other has width - 1. With similarity
    t that makes at most width * (1 - t) * n, if width - 1 <= width * t; so the first runs beyond that number hold an unbroken one.
    Where a set has too few runs, both ends of the order are neighbours too.
    """
    most, ends = width * (100 - percent) * len(s) // 100 + 1, np.array([0], np.uint64)
    if most > len(s) - width + 1:
        s = np.concatenate([ends, s, ends - np.uint64(1)])
        most = max(0, len(s) - width + 1)
    mixed = np.zeros(min(most, max(0, len(s) - width + 1)), np.uint64)
    for k in range(width):
        mixed += s[k : k + len(mixed)] * MULTIPLIERS[(4 + k) % 8]
    return _mix(mixed + np.uint64(width))


def wide(percent: int) -> int:
    """The longest runs that sets of WIDE_SIZE shingles can post and still have some to spare."""
    return max(2, 80 // max(1, 100 - percent))


def postings(s: np.ndarray, percent: int, width: int) -> np.ndarray:
    """Small sets always post pairs of neighbours, so that sets of similar size have posts of one kind in common."""
    if width == 2:
        return neighbour_runs(s, percent, 2)
    kinds = ([2] if len(s) * percent < 100 * WIDE_SIZE else []) + ([width] if len(s) >= WIDE_SIZE else [])
    return np.concatenate([neighbour_runs(s, percent, w) for w in kinds])


def _survey(n: int):
    """A document's set digest (null for an empty set) and size."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for ids, bodies in rows_of(batches):
            sets = [shingle_set(body, n, words) for body in bodies]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64())], schema=schema)

    return run


def _postings(n: int, percent: int, width: int):
    """(run of neighbours, id, set size); copies of a set within a task post once."""
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = WordHash(), set()
        for ids, bodies in rows_of(batches):
            pairs, whose, sizes = [np.empty(0, np.uint64)], [], []
            for i, body in zip(ids, bodies, strict=True):
                s = shingle_set(body, n, words)
                if i is None or not len(s) or (key := xxhash.xxh3_128_digest(s.tobytes())) in done:
                    continue
                done.add(key)
                pairs.append(postings(s, percent, width))
                whose.append(i)
                sizes.append(len(s))
            counts = [len(p) for p in pairs[1:]]
            columns = [np.concatenate(pairs).view(np.int64), np.repeat(np.array(whose, np.int64), counts), np.repeat(np.array(sizes, np.int32), counts)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run


# ---- signature trees -------------------------------------------------------------------------------------------------


def bitmap(s: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS, bool)
    out[(s % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(out).view(np.uint64)


class Node:
    """lo, hi: set sizes; spare: most tokens of a member beyond its bits; at: member positions."""

    __slots__ = ("at", "bits", "children", "hi", "lo", "spare")

    def __init__(self, at: np.ndarray, bits: np.ndarray, lo: int, hi: int, spare: int, children: list[Node]):
        self.at, self.bits, self.lo, self.hi, self.spare, self.children = at, bits, lo, hi, spare, children


def build_tree(sets: list[np.ndarray], bits: np.ndarray, at: np.ndarray) -> Node:
    """Members in order of their smallest hashes, so that similar ones share leaves; then level upon level."""
    sizes = np.array([len(sets[i]) for i in at])
    spare = sizes - np.bitwise_count(bits[at]).sum(axis=1)
    order = np.lexsort((sizes, [int(sets[i][0]) for i in at]))
    level = []
    for k in range(0, len(at), LEAF):
        own = order[k : k + LEAF]
        level.append(Node(at[own], np.bitwise_or.reduce(bits[at[own]]), int(sizes[own].min()), int(sizes[own].max()), int(spare[own].max()), []))
    while len(level) > 1:
        up = []
        for k in range(0, len(level), FANOUT):
            c = level[k : k + FANOUT]
            up.append(Node(np.concatenate([x.at for x in c]), np.bitwise_or.reduce([x.bits for x in c]), min(x.lo for x in c), max(x.hi for x in c), max(x.spare for x in c), c))
        level = up
    return level[0]


def may_link(x: Node, y: Node, percent: int) -> bool:
    """Whether the maximum possible overlap of two members suffices; J >= t means overlap * (100 + t) >= t * (a + b)."""
    if 100 * x.hi < percent * y.lo or 100 * y.hi < percent * x.lo:
        return False
    most = min(x.hi, y.hi, int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.spare, y.spare))
    return most * (100 + percent) >= percent * (x.lo + y.lo)


class Links:
    """Union-find over member positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def all_one(self, at: np.ndarray) -> bool:
        roots = self.up[at]
        while (roots != (roots := self.up[roots])).any():
            pass
        self.up[at] = roots
        return bool((roots == roots[0]).all())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def link(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None, links: Links | None = None) -> Links:
    """Components among sets. left: a mask; then only pairs of one member within the mask and one outside count."""
    links = links or Links(len(sets))
    if len(sets) == 2:
        if similar(sets[0], sets[1], percent):
            links.join(0, 1)
        return links
    bits = np.stack([bitmap(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    spare = sizes - np.bitwise_count(bits).sum(axis=1)
    every = np.arange(len(sets))
    if left is None:
        root = build_tree(sets, bits, every)
        todo = [(root, root)]
    else:
        if left.all() or not left.any():
            return links
        todo = [(build_tree(sets, bits, every[left]), build_tree(sets, bits, every[~left]))]
    while todo:
        x, y = todo.pop()
        if not may_link(x, y, percent) or links.all_one(x.at if x is y else np.concatenate([x.at, y.at])):
            continue
        if x.children or y.children:
            if x is y:
                c = x.children
                todo += [(c[i], c[j]) for i in range(len(c)) for j in range(i + 1, len(c))] + [(n, n) for n in c]  # own pairs first
            elif len(x.at) >= len(y.at) and x.children:
                todo += [(n, y) for n in x.children]
            else:
                todo += [(x, n) for n in y.children]
            continue
        common = np.bitwise_count(bits[x.at][:, None, :] & bits[y.at][None, :, :]).sum(axis=2) + np.minimum(spare[x.at][:, None], spare[y.at][None, :])
        total = sizes[x.at][:, None] + sizes[y.at][None, :]
        close = common * (100 + percent) >= percent * total
        for i, j in np.argwhere(np.triu(close, 1) if x is y else close):
            a, b = int(x.at[i]), int(y.at[j])
            if links.find(a) != links.find(b) and similar(sets[a], sets[b], percent):
                links.join(a, b)
    return links


def _verify(n: int, percent: int):
    """Of a task's rows (grp, side, id, body), star edges of the components within each grp. side: 0 all pairs, 1 and 2 pairs across."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words, out = WordHash(), []
        for _, g in pdf.groupby("grp", sort=False):
            sets = [shingle_set(b, n, words) for b in g["body"]]
            side, ids = g["side"].to_numpy(), g["id"].to_numpy()
            links = Links(len(sets))
            if "known" in g:  # what is known to be connected needs no comparison
                known: dict[int, int] = {}
                for i, c in enumerate(g["known"]):
                    links.join(known.setdefault(c, i), i)
            links = link(sets, percent, side == 1 if side.max() > 0 else None, links)
            roots = [links.find(i) for i in range(len(sets))]
            out += [(ids[i], ids[r]) for i, r in enumerate(roots) if i != r]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _tasks(rows: DataFrame, n: int, percent: int) -> DataFrame:
    return rows.groupBy("task").applyInPandas(_verify(n, percent), "a long, b long")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs.

    A-Z are lower-cased; words are runs of characters other than \\x20 and \\x09-\\x0D; a set has the distinct n-word shingles,
    or the whole sequence if there are fewer words. Two documents link when 100 * intersection >= percent * union.
    component_id is the smallest id that links reach. Shingles are compared by 64-bit hashes.
    Null and empty texts, and texts of white space, have no shingles and are their own component. Rows that repeat an id are
    one node of the graph and all come back. A null id takes no part; its component_id is that of its exact copies, or null.
    An empty table gives an empty result; other columns of docs are ignored.
    """
    texts = text_bytes(docs, id_col, text_col)
    members = materialize(texts.mapInArrow(_survey(n), "id long, key binary, n long"), "members")
    reps = materialize(members.where("key is not null").groupBy("key").agg(F.min("id").alias("rep")), "reps")

    near = _groups(texts, n, percent, 2)
    # copies that several tasks posted are one representative
    groups = near.join(members, near.node == members.id).join(reps, "key").select(F.col("rep").alias("id"), F.col("component").alias("grp")).distinct()
    groups = materialize(groups, "groups")

    small, large = _by_size(groups)
    edges = []
    if large:
        # longer runs of neighbours tell the members of large groups apart
        held = materialize(texts.join(groups.join(large[0], "grp").select("id"), "id"), "held")
        finer = materialize(_groups(held, n, percent, wide(percent)).select(F.col("node").alias("id"), F.col("component").alias("grp")), "finer")
        finer_small, finer_large = _by_size(finer)
        edges += [_alone(held, finer, finer_small, n, percent)]
        if finer_large:
            edges += _large(held.join(finer.join(finer_large[0], "grp"), "id"), n, percent)
    edges.append(_alone(texts, groups, small, n, percent))
    found = edges[0]
    for e in edges[1:]:
        found = found.union(e)
    labels = components(found)
    known = reps.join(labels, reps.rep == labels.node, "left").select("key", F.coalesce("component", "rep").alias("component"))
    return members.join(known, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def _groups(texts: DataFrame, n: int, percent: int, width: int) -> DataFrame:
    """(node, component) of the candidate groups with more than one member."""
    posted = texts.mapInArrow(_postings(n, percent, width), "h long, id long, n int")
    by_size = Window.partitionBy("h").orderBy("n", "id")
    starts = F.coalesce(100 * F.lag("n").over(by_size) < percent * F.col("n"), F.lit(True))
    runs = posted.withColumn("start", F.when(starts, F.col("id")))
    runs = runs.withColumn("hub", F.last("start", ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    return components(runs.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())


def _by_size(groups: DataFrame) -> tuple[tuple[DataFrame, int] | None, tuple[DataFrame, int] | None]:
    """(grp, m) and the number of members of small groups, and of large ones; None where there are none."""
    sizes = materialize(groups.groupBy("grp").agg(F.count("id").alias("m")), "sizes")
    small, large = sizes.agg(F.sum(F.when(F.col("m") <= BLOCK, F.col("m"))), F.sum(F.when(F.col("m") > BLOCK, F.col("m")))).first()
    return (sizes.where(F.col("m") <= BLOCK), small) if small else None, (sizes.where(F.col("m") > BLOCK), large) if large else None


def _alone(texts: DataFrame, groups: DataFrame, sizes: tuple[DataFrame, int] | None, n: int, percent: int) -> DataFrame:
    """Edges within groups that fit a task; about BLOCK members go to a task together."""
    if not sizes:
        return groups.where("false").select(F.col("id").alias("a"), F.col("id").alias("b"))
    own = texts.join(groups.join(sizes[0], "grp").select("id", "grp"), "id")
    return _tasks(own.select("id", "body", F.pmod(F.xxhash64("grp"), F.lit(ceil(sizes[1] / BLOCK))).alias("task"), "grp", F.lit(0).alias("side")), n, percent)


def _large(rows: DataFrame, n: int, percent: int) -> list[DataFrame]:
    """Edges within candidate groups of more than BLOCK members.

    First each block alone, so that the copies of one text soon are one component; then blocks are made anew, sorted by what is
    connected, and pairs of blocks are compared unless all members of both are connected already.
    """
    parts = F.ceil(F.col("m") / F.lit(BLOCK)).cast("long")
    block = F.pmod(F.xxhash64("id"), parts)
    inner = rows.select("id", "body", F.xxhash64("grp", block).alias("task"), F.col("grp"), F.lit(0).alias("side"))
    first = materialize(_tasks(inner, n, percent), "inner")
    # the smallest member of each component in a block stands for it among those of other blocks
    labels = components(first)
    tops = rows.join(labels, rows.id == labels.node, "left").withColumn("known", F.coalesce("component", "id")).drop("node", "component")
    heads = materialize(tops.where(F.col("known") == F.col("id")), "heads")
    across = _pairs(heads, n, percent)
    second = materialize(across, "heads-links")
    both = materialize(components(first.union(second)), "both")
    whole = materialize(rows.join(both, rows.id == both.node, "left").withColumn("known", F.coalesce("component", "id")).drop("node", "component"), "whole")
    return [first, second, _pairs(whole, n, percent)]


def _pairs(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges between blocks of rows(grp, id, body, known). Members of one block have one known component where it fills a block."""
    per = rows.groupBy("grp", "known").agg(F.count("id").alias("k"))
    per = per.withColumn("cell", F.when(F.col("k") > BLOCK, F.struct(F.col("known").alias("c"), F.lit(-1).cast("long").alias("r"))))
    loose = per.where(F.col("cell").isNull()).groupBy("grp").agg(F.sum("k").alias("loose"))
    cell = per.join(loose, "grp", "left").select("grp", "known", F.when(F.col("cell").isNotNull(), F.col("known")).otherwise(F.lit(-1).cast("long")).alias("c"), F.ceil(F.when(F.col("cell").isNotNull(), F.col("k")).otherwise(F.col("loose")) / F.lit(BLOCK)).cast("long").alias("parts"))
    placed = rows.join(cell, ["grp", "known"]).withColumn("r", F.pmod(F.when(F.col("c") >= 0, F.xxhash64("id")).otherwise(F.xxhash64("known")), F.col("parts"))).drop("parts")
    blocks = materialize(placed.select("grp", "c", "r").distinct(), "blocks")
    x, y = blocks.alias("x"), blocks.alias("y")
    left, right = F.struct("x.c", "x.r"), F.struct("y.c", "y.r")
    pairs = x.join(y, F.col("x.grp") == F.col("y.grp")).where((left <= right) & ((F.col("x.c") != F.col("y.c")) | (F.col("x.c") < 0)))
    pairs = pairs.select(F.col("x.grp").alias("grp"), F.xxhash64("x.grp", left, right).alias("task"), F.array(F.struct(F.col("x.c").alias("c"), F.col("x.r").alias("r"), F.when(left == right, 0).otherwise(1).alias("side")), F.struct(F.col("y.c").alias("c"), F.col("y.r").alias("r"), F.when(left == right, 0).otherwise(2).alias("side"))).alias("ends"))
    ends = pairs.select("grp", "task", F.explode(F.array_distinct("ends")).alias("e")).select("grp", "task", "e.c", "e.r", "e.side")
    return _tasks(placed.join(ends, ["grp", "c", "r"]).select("id", "body", "task", "grp", "side", "known"), n, percent)
