"""Algebra of assignments (id, shard): sizes, balance, compaction, sampling, random shards, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shard_sizes(assignment: DataFrame, shards: int | None = None) -> DataFrame:
    """(shard, size); with a number of shards, empty ones too."""
    own = assignment.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    if shards is None:
        return own
    every = assignment.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(own, "shard", "left").select("shard", F.coalesce("size", F.lit(0)).alias("size"))


def num_parts(assignment: DataFrame) -> DataFrame:
    return assignment.agg(F.coalesce(F.max("shard") + 1, F.lit(0)).cast("bigint").alias("num_parts"))


def imbalance(assignment: DataFrame, k: int) -> DataFrame:
    """(max_size, imbalance, min_imbalance): the largest and smallest shard over the whole-number mean n div k."""
    sizes = shard_sizes(assignment)
    mean = F.greatest(F.floor(F.sum("size") / k), F.lit(1))
    return sizes.agg(F.max("size").alias("max_size"), (F.max("size") / mean).alias("imbalance"), (F.min("size") / mean).alias("min_imbalance"))


def overloaded(assignment: DataFrame, cap: int) -> DataFrame:
    return shard_sizes(assignment).where(F.col("size") > cap).withColumn("excess", F.col("size") - cap)


def compact_ids(assignment: DataFrame) -> DataFrame:
    """Shard ids without gaps, in the same order. Only the distinct ids meet in one task."""
    ids = assignment.select("shard").distinct().withColumn("to", (F.dense_rank().over(Window.orderBy("shard")) - 1).cast("int"))
    return assignment.join(ids, "shard").select("id", F.col("to").alias("shard"))


def prefix_offsets(sizes: DataFrame) -> DataFrame:
    """(shard, size, start): where each shard starts if they lie one behind another. One row for each shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))


def cover_of(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """(id, n_shards): in how many shards each point is, 0 for those in none."""
    own = clusters.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_shards"))
    return points.select("id").join(own, "id", "left").select("id", F.coalesce("n_shards", F.lit(0)).alias("n_shards"))


def gather(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points of a list of ids; an id that the list repeats comes as often."""
    return ids.join(points, "id")


def hash_order(seed: int, *keys: str) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


def random_sample(points: DataFrame, m: int, seed: int) -> DataFrame:
    """m rows without replacement, or all: the first in a hash order, which doesn't depend on partitions."""
    return points.orderBy(hash_order(seed, "id"), "id").limit(m)


def random_shards(points: DataFrame, k: int, seed: int = 555) -> DataFrame:
    """k shards whose sizes differ by one at most.

    Ids are dealt in hash order: first to ranges of the hash, whose sizes give each range its start, then in order within them.
    """
    buckets = 1024
    keyed = points.select("id", hash_order(seed, "id").alias("h")).withColumn("g", F.floor((F.col("h") / 2.0**64 + 0.5) * buckets).cast("int"))
    starts = prefix_offsets(keyed.groupBy(F.col("g").alias("shard")).agg(F.count(F.lit(1)).alias("size"))).select(F.col("shard").alias("g"), "start")
    place = F.row_number().over(Window.partitionBy("g").orderBy("h", "id")) - 1
    return keyed.withColumn("p", place).join(starts, "g").select("id", F.pmod(F.col("p") + F.col("start"), F.lit(k)).cast("int").alias("shard"))


def random_routes(queries: DataFrame, shards: DataFrame, seed: int = 555) -> DataFrame:
    """(query_id, probe_rank, shard): all shards in an order of their own for each query."""
    pairs = queries.select("query_id").crossJoin(F.broadcast(shards.select("shard").distinct()))
    w = Window.partitionBy("query_id").orderBy(hash_order(seed, "query_id", "shard"), "shard")
    return pairs.select("query_id", F.row_number().over(w).alias("probe_rank"), "shard")


def degree_stats(sizes: DataFrame, quantiles: tuple[float, ...] = tuple(q / 10 for q in range(11))) -> DataFrame:
    """(quantile, size, mean): positional quantiles of sizes(size): the element at floor(q * n), the last at most."""
    ordered = sizes.select("size", (F.row_number().over(Window.orderBy("size")) - 1).alias("at"))
    n = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    asked = n.select("mean", F.explode(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1).alias("at")) for q in quantiles])).alias("q"))
    return asked.select("mean", "q.quantile", "q.at").join(ordered, "at").select("quantile", "size", "mean")


def budget_shares(moves: DataFrame, budget: int) -> DataFrame:
    """moves(shard, m) with take: what each shard may take, shard by shard, until the budget is spent."""
    before = F.coalesce(F.sum("m").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return moves.withColumn("take", F.greatest(F.lit(0), F.least(F.col("m"), F.lit(budget) - before)))


def up_to(last: dict[int, int]) -> Column:
    """Whether the id of a row(id, shard) isn't past the last of its shard."""
    if not last:
        return F.lit(True)
    of = F.create_map(*[F.lit(x) for s, i in sorted(last.items()) for x in (s, i)])
    return F.coalesce(F.col("id") <= F.try_element_at(of, F.col("shard")), F.lit(True))


def last_ids(rows: DataFrame, room: dict[int, int], bins: int = 1024) -> dict[int, int]:
    """The id up to which each shard of rows(id, shard) has room; shards that have room for all aren't named.

    Ids are counted in bins and the bin where room ends is counted anew, so nothing is sorted and only bins go to the driver. A shard
    without room, or not in room, gets an id below its least. Rows of one id fit together or not at all.
    """
    stats = {r["shard"]: r for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
    out = {s: r["lo"] - 1 for s, r in stats.items() if r["n"] > room.get(s, 0) <= 0}
    open_ = {s: (r["lo"], r["hi"], room[s]) for s, r in stats.items() if r["n"] > room.get(s, 0) > 0}
    while open_:
        at = F.lit(None).cast("long")
        for s, (lo, hi, _) in open_.items():
            step = (hi - lo) // bins + 1
            gap = (F.col("id").cast("decimal(20,0)") if hi - lo >= 2**63 else F.col("id")) - F.lit(lo)
            at = F.when((F.col("shard") == s) & F.col("id").between(lo, hi), F.round((gap - gap % F.lit(step)) / F.lit(step)).cast("long")).otherwise(at)
        held: dict[int, dict[int, int]] = {}
        for r in rows.withColumn("bin", at).where("bin is not null").groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
            held.setdefault(r["shard"], {})[r["bin"]] = r["n"]
        nxt = {}
        for s, (lo, hi, left) in open_.items():
            step = (hi - lo) // bins + 1
            for b in sorted(held[s]):
                if held[s][b] > left:
                    if step == 1 or not left:  # no further id fits
                        out[s] = lo + b * step - 1
                    else:
                        nxt[s] = (lo + b * step, min(hi, lo + (b + 1) * step - 1), left)
                    break
                left -= held[s][b]
        open_ = nxt
    return out
