"""Neighbour graphs: symmetry, degree, cut, and the approximate kNN graph by recursive sketching."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .neighbours import bucket_graph, nearest_in_parts
from .shards import hash_order


def symmetrise(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): each edge in both directions; mutual edges weigh 2."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def cut_degree(edges: DataFrame, degree: int) -> DataFrame:
    return edges.where(F.col("rank") <= degree)


def edge_cut(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cut, edges): directed edges whose ends are in different shards, and all."""
    a, b = assignment.select(F.col("id").alias("src"), F.col("shard").alias("s")), assignment.select(F.col("id").alias("dst"), F.col("shard").alias("t"))
    return edges.join(a, "src").join(b, "dst").agg(F.count_if(F.col("s") != F.col("t")).alias("cut"), F.count(F.lit(1)).alias("edges"))


@dataclass(frozen=True)
class Sketch:
    """How points are cut into buckets: leaders of the top level and the share of lower ones, and sizes."""

    top_leaders: int = 950
    share: float = 0.005
    least_leaders: int = 3
    most_leaders: int = 1500
    bucket: int = 5000
    tiny: int = 50
    merged: int = 2500
    fanout: int = 3
    repetitions: int = 3
    max_depth: int = 14
    doubtful_depth: int = 10  # deeper nodes that keep more than unshrunk of their parent are cut by hash
    unshrunk: float = 0.8
    seed: int = 555


SENT = 200_000  # children of a level, of some hundred bytes each, that go to every executor at most
STRONG = Sketch(fanout=5, repetitions=5)


def sketch_buckets(points: DataFrame, how: Sketch, metric: str = "l2") -> DataFrame:
    """(bucket, id): all nodes of a level are split in one pass; nothing but leaders within a checked size goes to the driver.

    A node's points go to their nearest leaders, to several at the top level. Children under tiny are packed into buckets; nodes that don't
    shrink any more, as copies don't, are cut by hash. Each repetition has leaders of its own; a table of one bucket has one repetition.
    """
    vectors = materialize(points.select("id", F.col("vec").cast("array<double>").alias("vec")), "sketch")
    whole = F.lit(vectors.count()).cast("long")
    out = None
    for rep in range(how.repetitions):
        now, depth = vectors.select("id", "vec", F.lit(f"{rep}").alias("node"), whole.alias("n"), F.lit(None).cast("long").alias("above"), F.lit(False).alias("packed")), 0
        while True:
            # copies and near-copies don't shrink: they are cut by hash
            stuck = F.lit(depth > how.max_depth + 1) | (F.lit(depth > how.doubtful_depth + 1) & (F.col("n") > how.unshrunk * F.col("above")))
            cut = F.pmod(hash_order(how.seed, "id"), F.ceil(F.col("n") / how.bucket))
            fits = F.col("packed") | (F.col("n") <= how.bucket)
            small, large = now.where(fits).select(F.col("node").alias("bucket"), "id"), now.where(~fits)
            ended = small.unionByName(large.where(stuck).select(F.concat_ws("#", "node", cut.cast("string")).alias("bucket"), "id"))
            out = ended if out is None else out.unionByName(ended)
            rest = large.where(~stuck)
            if rest.isEmpty():
                break
            now = _pack_tiny(_to_leaders(rest, _leaders(rest, how, rep, depth), how.fanout if depth == 0 else 1, metric), how)
            depth += 1
        if depth == 0:
            break
    return out


def _leaders(rest: DataFrame, how: Sketch, rep: int, depth: int) -> DataFrame:
    """(id, vec, part): the leaders of each node, by a hash order; only rows under a hash threshold of about twice as many are ordered."""
    n = F.col("n")
    wanted = F.lit(how.top_leaders).cast("long") if depth == 0 else F.floor(n * how.share)
    wanted = F.least(F.lit(how.most_leaders).cast("long"), F.greatest(F.lit(how.least_leaders).cast("long"), wanted))
    keyed = rest.select("id", "vec", "node", wanted.alias("wanted"), "n", hash_order(how.seed + 7919 * rep + depth, "id", "node").alias("h"))
    near = keyed.where((F.col("h") / 2.0**64 + 0.5) * F.col("n") <= 2 * F.col("wanted") + 64)
    r = F.row_number().over(Window.partitionBy("node").orderBy("h", "id"))
    return near.withColumn("r", r).where(F.col("r") <= F.col("wanted")).select(F.col("r").cast("long").alias("id"), "vec", F.col("node").alias("part"))


def _to_leaders(rows: DataFrame, leaders: DataFrame, fanout: int, metric: str) -> DataFrame:
    near = nearest_in_parts(rows.select("id", "vec", F.col("node").alias("part"), "n"), materialize(leaders, "leaders"), fanout, metric, ("vec", "n"))
    return near.select("id", "vec", F.concat_ws(".", "part", F.col("leader").cast("string")).alias("node"), F.col("n").alias("above"))


def _pack_tiny(rows: DataFrame, how: Sketch) -> DataFrame:
    """Children under tiny, smallest first, share buckets of about how.merged points. One row for each child is ordered.

    Children up to SENT go to the vectors; beyond that, vectors meet them in a join.
    """
    parent = F.regexp_extract("node", r"^(.*)\.[^.]*$", 1)
    rows = materialize(rows, "children")
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).withColumn("parent", parent)
    so_far = F.sum("n").over(Window.partitionBy("parent").orderBy("n", "node"))
    packed = F.col("n") < how.tiny
    to = F.when(packed, F.concat("parent", F.lit(".m"), F.floor(so_far / F.lit(how.merged)).cast("string"))).otherwise(F.col("node"))
    sizes = materialize(sizes.select("node", to.alias("to"), "n", packed.alias("packed")), "sizes")
    if sizes.count() <= SENT:
        sizes = F.broadcast(sizes)
    return rows.join(sizes, "node").select("id", "vec", F.col("to").alias("node"), "n", "above", "packed")


def approximate_graph(points: DataFrame, k: int, how: Sketch | None = None, metric: str = "l2") -> DataFrame:
    """Edges (src, dst, rank, dist): exact within sketched buckets, merged over buckets and repetitions."""
    return bucket_graph(points, sketch_buckets(points, how or Sketch(), metric), k, metric)
