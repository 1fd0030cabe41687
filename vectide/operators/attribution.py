"""Attribution: recall and work of every combination of route and search, replicas, throughput, the Pareto front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recall import recall_by_probes


def work_by_probes(routes: DataFrame, cost: DataFrame, shards: int, extra: list[str] | None = None) -> DataFrame:
    """(extra..., probes, shard, work): what each shard has done after so many probes.

    cost: (query_id, shard, cost), or what a query costs by columns of routes, as (shard, cost) or (ef, shard, cost).
    """
    extra = extra or []
    own = routes.join(cost, [c for c in cost.columns if c != "cost"]).groupBy(*extra, "probe_rank", "shard").agg(F.sum("cost").alias("work"))
    # each share counts for its own probe and all later ones
    later = own.select(*extra, "shard", "work", F.explode(F.sequence(F.col("probe_rank"), F.lit(shards))).alias("probes"))
    return later.groupBy(*extra, "probes", "shard").agg(F.sum("work").alias("work"))


def increasing(routes: DataFrame, hits: DataFrame, cost: DataFrame, shards: int, k: int, n_queries: int, extra: list[str] | None = None) -> DataFrame:
    """(extra..., probes, recall, max_work, total_work) for 1 to shards probes."""
    extra = extra or []
    work = work_by_probes(routes, cost, shards, extra).groupBy(*extra, "probes").agg(F.max("work").alias("max_work"), F.sum("work").alias("total_work"))
    return recall_by_probes(routes, hits, shards, k, n_queries, extra).join(work, [*extra, "probes"])


def variable(routes: DataFrame, hits: DataFrame, k: int, n_queries: int, extra: list[str] | None = None) -> DataFrame:
    """(extra..., probes, recall): one row for a route whose lists differ in length; probes is their mean length."""
    extra = extra or []
    both = routes.join(hits, ["query_id", "shard"]).groupBy(*extra, "query_id").agg(F.least(F.lit(k), F.count_distinct("neighbor_id")).alias("c"))
    lengths = routes.groupBy(*extra).agg((F.count(F.lit(1)) / F.lit(float(n_queries))).alias("probes"))
    sums = both.groupBy(*extra).agg(F.sum("c").alias("c"))
    joined = lengths.join(sums, extra, "left") if extra else lengths.crossJoin(sums)
    return joined.select(*extra, "probes", (F.coalesce("c", F.lit(0)) / F.lit(float(n_queries * k))).alias("recall"))


def replica_latency(work: DataFrame, extra_hosts: int, keys: list[str] | None = None) -> DataFrame:
    """(keys..., hosts, latency): one host for each shard, then one more at a time to the slowest shard.

    The largest load after t more hosts is the (t + 1)-th largest quotient work / j, as in highest-averages apportionment.
    """
    keys = keys or []
    quotients = work.select(*keys, "shard", F.explode(F.sequence(F.lit(1), F.lit(extra_hosts + 1))).alias("j"), F.col("work").cast("double").alias("work"))
    shards = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("shards"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("latency"), "shard", "j")  # shards times hosts rows
    ranked = quotients.withColumn("latency", F.col("work") / F.col("j")).withColumn("t", F.row_number().over(w) - 1).where(F.col("t") <= extra_hosts)
    joined = ranked.join(shards, keys) if keys else ranked.crossJoin(shards)
    return joined.select(*keys, (F.col("shards") + F.col("t")).cast("bigint").alias("hosts"), "latency")


def throughput(latencies: DataFrame, n_queries: int, routing_time: Column | float = 0.0) -> DataFrame:
    """latencies with qps_without_routing, qps and qps_per_host; routing is spread over all hosts."""
    routing = routing_time if isinstance(routing_time, Column) else F.lit(float(routing_time))
    qps = F.lit(float(n_queries)) / (F.col("latency") + routing / F.col("hosts"))
    return latencies.withColumns({"qps_without_routing": F.lit(float(n_queries)) / F.col("latency"), "qps": qps, "qps_per_host": qps / F.col("hosts")})


def pareto_front(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of rows(recall, qps, ...), those that no other row beats in both; one of equal pairs. keys: one front for each."""
    keys = keys or []
    once = rows.dropDuplicates([*keys, "recall", "qps"])
    # of one recall only the best qps can be on the front: so few rows are left for the running maximum
    once = once.withColumn("top", F.max("qps").over(Window.partitionBy(*keys, "recall"))).where(F.col("qps") == F.col("top")).drop("top")
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("qps"), F.desc("recall")).rowsBetween(Window.unboundedPreceding, -1)
    return once.withColumn("most", F.max("recall").over(before)).where(F.col("most").isNull() | (F.col("recall") > F.col("most"))).drop("most")
