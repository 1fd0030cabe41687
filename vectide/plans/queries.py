"""Named queries over the embeddings table, with DuckDB SQL for those that SQL can express.

Points are the vectors whose id is no multiple of 10, queries those whose is; shards are the labels, unless a query says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import attribution, centroids, graphs, methods, neighbours, overlap, recall, routing, search, shards, trees
from . import sweeps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K, SHARDS = 10, 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables that queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.all = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("shard"))
        self.points = self.all.where(F.col("id") % 10 != 0).select("id", "vec")
        self.queries = self.all.where(F.col("id") % 10 == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
        self.assignment = self.all.where(F.col("id") % 10 != 0).select("id", "shard")
        more = self.assignment.where(F.col("id") % 5 == 1).select("id", ((F.col("shard") + 1) % SHARDS).alias("shard"))
        self.cover = self.assignment.unionByName(more)
        self.shards = self.assignment.select("shard").distinct()
        self.scaled = self.all.select("id", F.transform("vec", lambda x: x * (1 + F.col("id") % 3)).alias("vec"), "shard")

    def truth(self) -> DataFrame:
        return neighbours.ground_truth(self.points, self.queries, K)

    def n_queries(self) -> int:
        return self.queries.count()

    def center_routes(self) -> DataFrame:
        return routing.by_distance(routing.single_center(centroids.centers(self.points, self.assignment), self.queries))

    def hits(self) -> DataFrame:
        """True neighbours found by exact search in each shard."""
        every = self.queries.select("query_id").crossJoin(F.broadcast(self.shards)).withColumn("probe_rank", F.lit(1))  # one row for each shard
        found = search.search_probes(self.points, self.cover, self.queries, every, K)
        return search.true_hits(found, neighbours.kth_distance(self.truth(), K)).select("query_id", "shard", "neighbor_id", "dist")

    def cost(self) -> DataFrame:
        """Points scanned by each query in each shard."""
        return self.queries.select("query_id").crossJoin(F.broadcast(shards.shard_sizes(self.cover).withColumnRenamed("size", "cost")))  # one row for each shard


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- SQL fragments ---------------------------------------------------------------------------------------------------

_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _ip(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


_ALL = f"everything AS (SELECT vec_id AS id, {_V} AS v, label AS shard FROM embeddings)"
_SCALED = f"scaled AS (SELECT vec_id AS id, list_transform({_V}, lambda x: x * (1 + vec_id % 3)) AS v, label AS shard FROM embeddings)"
_POINTS = f"points AS (SELECT vec_id AS id, {_V} AS v, label AS shard FROM embeddings WHERE vec_id % 10 <> 0), queries AS (SELECT vec_id AS query_id, {_V} AS qv FROM embeddings WHERE vec_id % 10 = 0)"
_PAIRS = f"{_POINTS}, pairs AS MATERIALIZED (SELECT query_id, id, shard, {_l2('v', 'qv')} AS dist FROM points, queries)"
_TRUTH = f"{_PAIRS}, truth AS MATERIALIZED (SELECT query_id, rank, id AS neighbor_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM pairs) WHERE rank <= {K})"
_COVER = f"cover AS (SELECT id, shard FROM points UNION ALL SELECT id, (shard + 1) % {SHARDS} FROM points WHERE id % 5 = 1)"
_CENTERS = "center_values AS (SELECT shard, pos, avg(x) AS value FROM (SELECT shard, unnest(range(len(v))) AS pos, unnest(v) AS x FROM points) GROUP BY shard, pos), centers AS (SELECT shard, list(value ORDER BY pos) AS c FROM center_values GROUP BY shard)"
_ROUTES = f"{_CENTERS}, routes AS MATERIALIZED (SELECT query_id, shard, row_number() OVER (PARTITION BY query_id ORDER BY {_l2('c', 'qv')}, shard) AS probe_rank FROM queries, centers)"
_HITS = f"{_TRUTH}, {_COVER}, kth AS (SELECT query_id, max(dist) AS kth FROM truth GROUP BY query_id), hits AS MATERIALIZED (SELECT p.query_id, c.shard, p.id AS neighbor_id FROM pairs p JOIN cover c ON p.id = c.id JOIN kth k ON p.query_id = k.query_id AND p.dist <= k.kth)"
_NQ = "(SELECT count(*) FROM queries)"
_BY_PROBES = f"""
first_probe AS (SELECT query_id, neighbor_id, min(probe_rank) AS p FROM routes JOIN hits USING (query_id, shard) GROUP BY ALL),
counts AS (SELECT g.p, query_id, least({K}, count(*)) AS c FROM (SELECT unnest(range(1, {SHARDS} + 1)) AS p) g JOIN first_probe f ON f.p <= g.p GROUP BY g.p, query_id),
by_probes AS (SELECT g.p AS probes, coalesce(sum(c), 0) / ({_NQ} * {K}.0::DOUBLE) AS recall FROM (SELECT unnest(range(1, {SHARDS} + 1)) AS p) g LEFT JOIN counts USING (p) GROUP BY g.p)"""


# ---- vector functions ------------------------------------------------------------------------------------------------


def _neighbour_pairs(t: Tables, left: DataFrame) -> DataFrame:
    after = left.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w"))
    return left.select("id", "vec").join(after, "id")


def _pair_sql(value: str) -> str:
    return f"WITH {_SCALED} SELECT a.id, round({value}, 6) AS value FROM scaled a JOIN scaled b ON b.id = a.id + 1"


@query(_pair_sql(_l2("a.v", "b.v")))
def vec_l2sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(_neighbour_pairs(t, t.scaled).select("id", V.squared_l2(F.col("vec"), F.col("w")).alias("value")), "value")


@query(_pair_sql(_ip("a.v", "b.v")))
def vec_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(_neighbour_pairs(t, t.scaled).select("id", V.inner_product(F.col("vec"), F.col("w")).alias("value")), "value")


@query(_pair_sql("1 - " + _ip("a.v", "b.v")))
def vec_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(_neighbour_pairs(t, t.scaled).select("id", V.mips_distance(F.col("vec"), F.col("w")).alias("value")), "value")


@query(_pair_sql("2 - " + _ip("a.v", "b.v")))
def vec_pos_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(_neighbour_pairs(t, t.scaled).select("id", V.positive_distance(F.col("vec"), F.col("w"), "mips").alias("value")), "value")


@query(_pair_sql(_l2("a.v", "b.v")))
def vec_unrolled_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(_neighbour_pairs(t, t.scaled).select("id", V.unrolled_distance("vec", "w", 64).alias("value")), "value")


@query(f"WITH {_SCALED} SELECT id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS value FROM scaled")
def vec_norm_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).scaled.select("id", V.squared_norm(F.col("vec")).alias("value")), "value")


@query(f"WITH {_SCALED}, n AS (SELECT id, v, list_sum(list_transform(v, lambda x: x * x)) AS n2 FROM scaled) SELECT id, n2 >= 1e-10 AS done, round(v[1] / sqrt(n2), 6) AS first, round(v[64] / sqrt(n2), 6) AS last FROM n")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = Tables(spark, sf_dir).scaled.select("id", V.can_normalise(F.col("vec")).alias("done"), V.normalise(F.col("vec")).alias("u"))
    return rounded(unit.select("id", "done", F.col("u")[0].alias("first"), F.col("u")[63].alias("last")), "first", "last")


@query(f"WITH {_SCALED}, n AS (SELECT list_sum(list_transform(v, lambda x: x * x)) AS n2 FROM scaled) SELECT count(*) AS n, count(*) FILTER (abs(n2 - 1) < 1e-6) AS unit_before, count(*) AS unit_after FROM n")
def norm_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.norm_audit(Tables(spark, sf_dir).scaled)


@query("SELECT vec_id AS id, CAST(floor(vec_id / ceil(count(*) OVER () / 7.0)) AS INTEGER) AS chunk FROM embeddings")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).all
    return t.crossJoin(t.agg(F.count(F.lit(1)).alias("n"))).select("id", V.chunk_of(F.col("id"), F.col("n"), 7).alias("chunk"))


# ---- neighbours ------------------------------------------------------------------------------------------------------


@query(f"WITH {_TRUTH} SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(dist, 6) AS dist FROM truth")
def exact_knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).truth(), "dist")


@query(f"WITH {_SCALED}, p AS (SELECT q.id AS query_id, s.id AS neighbor_id, 1 - {_ip('q.v', 's.v')} AS dist FROM scaled q, scaled s WHERE q.id % 10 = 0 AND s.id % 10 <> 0) SELECT query_id, CAST(r AS INTEGER) AS rank, neighbor_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) AS r FROM p) WHERE r <= {K}")
def exact_knn_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).scaled
    asked = s.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    return rounded(neighbours.ground_truth(s.where("id % 10 <> 0"), asked, K, "mips"), "dist")


_GRAPH = f"{_ALL}, graph AS MATERIALIZED (SELECT src, dst, CAST(r AS INTEGER) AS rank, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM (SELECT a.id AS src, b.id AS dst, {_l2('b.v', 'a.v')} AS dist FROM everything a, everything b WHERE a.id <> b.id)) WHERE r <= {K})"


@query(f"WITH {_GRAPH} SELECT src, dst, rank, round(dist, 6) AS dist FROM graph")
def exact_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.exact_graph(Tables(spark, sf_dir).all.select("id", "vec"), K), "dist")


@query(f"WITH {_TRUTH} SELECT query_id, round(max(dist), 6) AS kth FROM truth GROUP BY query_id")
def kth_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.kth_distance(Tables(spark, sf_dir).truth(), K), "kth")


def _leaders_sql(k: int) -> str:
    return f"WITH {_ALL}, d AS (SELECT p.id, l.id AS leader, {_l2('p.v', 'l.v')} AS dist FROM everything p, everything l WHERE l.id < 16) SELECT id, CAST(r AS INTEGER) AS rank, leader, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, leader) AS r FROM d) WHERE r <= {k}"


@query(_leaders_sql(1))
def top1_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).all.select("id", "vec")
    return rounded(neighbours.closest_leaders(t, t.where("id < 16"), 1), "dist")


@query(_leaders_sql(3))
def closest_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).all.select("id", "vec")
    return rounded(neighbours.closest_leaders(t, t.where("id < 16"), 3), "dist")


@query(f"WITH {_TRUTH}, bent AS (SELECT query_id, rank, dist, dist + CASE WHEN query_id % 20 = 0 AND rank = 3 THEN 0.05 ELSE 0 END AS stored FROM truth), late AS (SELECT query_id, coalesce(bool_or(b > stored), false) AS late FROM (SELECT *, lag(stored) OVER (PARTITION BY query_id ORDER BY rank) AS b FROM bent) GROUP BY query_id) SELECT CAST(e AS INTEGER) AS eps_digits, CAST(count(*) FILTER (abs(stored - dist) > pow(10.0, -e)) AS BIGINT) AS mismatches, CAST((SELECT count(*) FROM late WHERE late) AS BIGINT) AS unsorted FROM bent, (SELECT unnest(range(1, 11)) AS e) GROUP BY e")
def gt_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    bent = t.truth().withColumn("dist", F.col("dist") + F.when((F.col("query_id") % 20 == 0) & (F.col("rank") == 3), 0.05).otherwise(0.0))
    return neighbours.truth_audit(bent, t.points, t.queries)


# ---- shards ----------------------------------------------------------------------------------------------------------


@query(f"WITH {_POINTS} SELECT s AS shard, count(id) AS size FROM (SELECT CAST(unnest(range(12)) AS INTEGER) AS s) LEFT JOIN points ON shard = s GROUP BY s")
def shard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_sizes(Tables(spark, sf_dir).assignment, 12)


@query(f"WITH {_POINTS}, s AS (SELECT count(*) AS size FROM points GROUP BY shard) SELECT max(size) AS max_size, max(size) / floor(sum(size) / 10.0)::DOUBLE AS imbalance, min(size) / floor(sum(size) / 10.0)::DOUBLE AS min_imbalance FROM s")
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.imbalance(Tables(spark, sf_dir).assignment, SHARDS)


@query(f"WITH {_POINTS} SELECT CAST(coalesce(max(shard) + 1, 0) AS BIGINT) AS num_parts FROM points")
def num_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.num_parts(Tables(spark, sf_dir).assignment)


@query(f"WITH {_POINTS} SELECT id, CAST(dense_rank() OVER (ORDER BY shard) - 1 AS INTEGER) AS shard FROM points WHERE shard % 3 <> 1")
def remap_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.compact_ids(Tables(spark, sf_dir).assignment.where("shard % 3 <> 1"))


@query(f"WITH {_POINTS}, {_COVER} SELECT p.id, CAST(count(c.id) AS BIGINT) AS n_shards FROM points p LEFT JOIN (SELECT DISTINCT * FROM cover WHERE shard < 5) c USING (id) GROUP BY p.id")
def clusters_to_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return shards.cover_of(t.cover.where("shard < 5"), t.points)


@query(f"WITH {_POINTS} SELECT shard, count(*) AS size, count(*) - 30 AS excess FROM points GROUP BY shard HAVING count(*) > 30")
def overloaded_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.overloaded(Tables(spark, sf_dir).assignment, 30)


@query(f"WITH {_POINTS}, s AS (SELECT shard, count(*) AS size FROM points GROUP BY shard) SELECT shard, size, CAST(coalesce(sum(size) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s")
def prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.prefix_offsets(shards.shard_sizes(Tables(spark, sf_dir).assignment))


@query()
def random_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.random_shards(Tables(spark, sf_dir).points, 7)


@query()
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.random_sample(Tables(spark, sf_dir).points, 100, 420).select("id")


@query(f"WITH {_POINTS}, m AS (SELECT shard, count(*) AS m FROM points WHERE id % 7 = 0 GROUP BY shard) SELECT shard, m, CAST(greatest(0, least(m, 30 - coalesce(sum(m) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS take FROM m")
def budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Tables(spark, sf_dir).assignment.where("id % 7 = 0").groupBy("shard").agg(F.count(F.lit(1)).alias("m"))
    return shards.budget_shares(m, 30).withColumn("take", F.col("take").cast("long"))


# ---- centers ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_POINTS}, {_CENTERS} SELECT shard, CAST(pos AS INTEGER) AS pos, round(value, 9) AS value FROM center_values")
def centroid_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(centroids.center_values(t.points, t.assignment), "value", digits=9)


@query(f"WITH {_SCALED}, n AS (SELECT shard, v, list_sum(list_transform(v, lambda x: x * x)) AS n2 FROM scaled), s AS (SELECT shard, pos, sum(x) AS s FROM (SELECT shard, unnest(range(len(v))) AS pos, unnest(list_transform(v, lambda x: x / sqrt(n2))) AS x FROM n) GROUP BY shard, pos), l AS (SELECT shard, avg(n2) AS m FROM n GROUP BY shard), t AS (SELECT shard, sum(s * s) AS t FROM s GROUP BY shard) SELECT shard, CAST(pos AS INTEGER) AS pos, round(s * sqrt(m / t), 6) AS value FROM s JOIN l USING (shard) JOIN t USING (shard)")
def centroid_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(centroids.center_values(t.scaled.select("id", "vec"), t.scaled.select("id", "shard"), "mips"), "value")


@query(f"WITH {_POINTS}, {_CENTERS} SELECT round(sum({_l2('v', 'c')}), 4) AS objective FROM points JOIN centers USING (shard)")
def kmeans_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(centroids.objective(t.points, t.assignment, centroids.centers(t.points, t.assignment)), "objective", digits=4)


_START = f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS c, v AS cv FROM points WHERE id < 9)"
_NEAR = "(SELECT id, v, c, dist, row_number() OVER (PARTITION BY id ORDER BY dist, c) AS r FROM (SELECT id, v, c, {l2} AS dist FROM points, {at}))"
_ROUND1 = f"{_POINTS}, {_START}, a1 AS MATERIALIZED (SELECT id, v, c, dist FROM {_NEAR.format(l2=_l2('v', 'cv'), at='c0')} WHERE r = 1)"
_ROUND2 = f"{_ROUND1}, c1 AS (SELECT CAST(row_number() OVER (ORDER BY c) - 1 AS INTEGER) AS c, list(value ORDER BY pos) AS cv FROM (SELECT c, pos, avg(x) AS value FROM (SELECT c, unnest(range(len(v))) AS pos, unnest(v) AS x FROM a1) GROUP BY c, pos) GROUP BY c), a2 AS (SELECT id, c, dist FROM {_NEAR.format(l2=_l2('v', 'cv'), at='c1')} WHERE r = 1)"


def _lowest(t: Tables) -> np.ndarray:
    return np.array([r["vec"] for r in t.points.where("id < 9").orderBy("id").collect()])


@query(f"WITH {_ROUND1} SELECT id, c AS shard, round(dist, 6) AS dist FROM a1")
def kmeans_assign_1round(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(centroids.kmeans(t.points, _lowest(t), rounds=1)[0], "dist")


@query(f"WITH {_ROUND2} SELECT id, c AS shard, round(dist, 6) AS dist FROM a2")
def kmeans_2rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(centroids.kmeans(t.points, _lowest(t), rounds=2)[0], "dist")


@query()
def kmeans_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.flat_kmeans(Tables(spark, sf_dir).points, SHARDS)


# ---- routing ---------------------------------------------------------------------------------------------------------

_OUT = "SELECT query_id, CAST(probe_rank AS INTEGER) AS probe_rank, shard FROM routes"


@query(f"WITH {_POINTS}, {_ROUTES} {_OUT}")
def route_single_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).center_routes()


@query(f"WITH {_PAIRS}, routes AS (SELECT query_id, shard, row_number() OVER (PARTITION BY query_id ORDER BY min(dist), shard) AS probe_rank FROM pairs GROUP BY query_id, shard) {_OUT}")
def route_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return routing.brute_force(t.points, t.assignment, t.queries)


@query(f"WITH {_TRUTH}, m AS (SELECT query_id, shard, min(dist) AS d FROM truth JOIN points ON neighbor_id = id GROUP BY ALL), e AS (SELECT query_id, s.shard, d FROM queries CROSS JOIN (SELECT DISTINCT shard FROM points) s LEFT JOIN m USING (query_id, shard)), routes AS (SELECT query_id, shard, row_number() OVER (PARTITION BY query_id ORDER BY d NULLS LAST, shard) AS probe_rank FROM e) {_OUT}")
def route_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return routing.by_distance(routing.from_truth(t.truth(), t.assignment), t.shards)


@query(f"WITH {_TRUTH}, m AS (SELECT query_id, count(DISTINCT shard) AS n FROM truth JOIN points ON neighbor_id = id GROUP BY query_id) SELECT count(*) FILTER (n < {SHARDS}) AS uncovered FROM m")
def uncovered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return routing.uncovered(routing.from_truth(t.truth(), t.assignment), SHARDS)


_VOTES = f"{_POINTS}, near AS (SELECT query_id, shard, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM (SELECT query_id, id, shard, {_l2('v', 'qv')} AS dist FROM queries, points)) WHERE r <= 20), voted AS MATERIALIZED (SELECT query_id, shard, min(dist) AS min_dist, count(*) AS votes FROM near GROUP BY query_id, shard)"


def _voted(t: Tables) -> DataFrame:
    return routing.votes(t.points.join(t.assignment, "id"), t.queries, 20)


@query(f"WITH {_VOTES} SELECT query_id, shard, round(min_dist, 6) AS min_dist, votes FROM voted")
def route_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_voted(Tables(spark, sf_dir)), "min_dist")


@query(f"WITH {_VOTES}, e AS (SELECT query_id, s.shard, min_dist, votes FROM queries CROSS JOIN (SELECT DISTINCT shard FROM points) s LEFT JOIN voted USING (query_id, shard)), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC NULLS LAST, shard) = 1 AS top FROM e), routes AS (SELECT query_id, shard, row_number() OVER (PARTITION BY query_id ORDER BY top DESC, min_dist NULLS LAST, shard) AS probe_rank FROM t) {_OUT}")
def route_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return routing.frequency(_voted(t), t.shards)


@query(f"WITH {_VOTES}, routes AS (SELECT query_id, shard, row_number() OVER (PARTITION BY query_id ORDER BY shard) AS probe_rank FROM voted) {_OUT}")
def route_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.pyramid(_voted(Tables(spark, sf_dir)))


@query(f"WITH {_VOTES}, c AS (SELECT *, min(min_dist) OVER (PARTITION BY query_id) AS m FROM voted), routes AS (SELECT query_id, shard, row_number() OVER (PARTITION BY query_id ORDER BY shard) AS probe_rank FROM c WHERE min_dist <= 1.1::DOUBLE * m) {_OUT}")
def route_spann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.spann(_voted(Tables(spark, sf_dir)), 0.1)


_ORACLE = "per AS (SELECT query_id, shard, count(*) AS freq FROM truth JOIN points ON neighbor_id = id GROUP BY ALL), routes AS (SELECT query_id, shard, freq, row_number() OVER (PARTITION BY query_id ORDER BY freq DESC, shard) AS probe_rank FROM per)"


@query(f"WITH {_TRUTH}, {_ORACLE} SELECT query_id, CAST(probe_rank AS INTEGER) AS probe_rank, shard, freq FROM routes")
def route_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return recall.oracle_routes(t.truth(), t.assignment)


@query()
def route_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return shards.random_routes(t.queries, t.shards)


@query()
def route_vote_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return routing.vote_sweep(t.points.join(t.assignment, "id"), t.queries, t.shards, (20, 40, 80))


# ---- search and recall -----------------------------------------------------------------------------------------------


@query(f"WITH {_PAIRS}, {_COVER}, {_ROUTES}, f AS (SELECT DISTINCT p.query_id, p.id, p.dist FROM pairs p JOIN cover c ON p.id = c.id JOIN routes r ON r.query_id = p.query_id AND r.shard = c.shard AND probe_rank <= 3) SELECT query_id, CAST(r AS INTEGER) AS rank, id AS neighbor_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM f) WHERE r <= {K}")
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(search.search_lists(t.points, t.cover, t.queries, t.center_routes(), K, 3), "dist")


@query(f"WITH {_PAIRS} SELECT query_id, CAST(r AS INTEGER) AS rank, id AS neighbor_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM pairs WHERE shard = 4) WHERE r <= {K}")
def ivf_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(search.search_shard(t.points, t.assignment, t.queries, 4, K), "dist")


@query(f"WITH {_PAIRS}, {_COVER}, f AS (SELECT DISTINCT query_id, p.id, dist FROM (SELECT c.shard AS s, p.*, row_number() OVER (PARTITION BY query_id, c.shard ORDER BY dist, p.id) AS r FROM pairs p JOIN cover c ON p.id = c.id) p WHERE r <= {K}) SELECT query_id, CAST(r AS INTEGER) AS rank, id AS neighbor_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM f) WHERE r <= {K}")
def dedup_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    every = t.queries.select("query_id").crossJoin(F.broadcast(t.shards)).withColumn("probe_rank", F.lit(1))  # one row for each shard
    return rounded(neighbours.dedup_neighbours(search.search_probes(t.points, t.cover, t.queries, every, K), K), "dist")


@query(f"WITH {_HITS}, {_ROUTES}, {_BY_PROBES} SELECT CAST(probes AS INTEGER) AS probes, round(recall, 9) AS recall FROM by_probes")
def recall_by_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(recall.recall_by_probes(t.center_routes(), t.hits(), SHARDS, K, t.n_queries()), "recall", digits=9)


@query(f"WITH {_TRUTH}, {_ORACLE}, hits AS (SELECT query_id, shard, neighbor_id FROM truth JOIN points ON neighbor_id = id), {_BY_PROBES} SELECT CAST(probes AS INTEGER) AS probes, round(recall, 9) AS recall FROM by_probes")
def oracle_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    truth = t.truth()
    return rounded(recall.recall_by_probes(recall.oracle_routes(truth, t.assignment), recall.neighbour_shards(truth, t.assignment), SHARDS, K, t.n_queries()), "recall", digits=9)


@query(f"WITH {_TRUTH}, {_ORACLE} SELECT CAST(probe_rank AS INTEGER) AS probes, round(sum(gain) OVER (ORDER BY probe_rank) / ({_NQ} * {K}.0::DOUBLE), 9) AS recall FROM (SELECT probe_rank, sum(freq) AS gain FROM routes GROUP BY probe_rank)")
def oracle_recall_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(recall.disjoint_oracle_recall(t.truth(), t.assignment, K), "recall", digits=9)


@query(f"WITH {_TRUTH}, per AS (SELECT query_id, shard, count(*) AS c FROM truth JOIN points ON neighbor_id = id GROUP BY ALL), m AS (SELECT query_id, max(c) AS c FROM per GROUP BY query_id) SELECT round(sum(c) / ({_NQ} * {K}.0::DOUBLE), 9) AS recall FROM m")
def first_shard_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(recall.first_shard_recall(t.truth(), t.assignment, K), "recall", digits=9)


@query(f"WITH {_TRUTH}, kth AS (SELECT query_id, max(dist) AS kth FROM truth GROUP BY query_id), f AS (SELECT query_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM pairs WHERE shard < 4) WHERE r <= {K}) SELECT round(count(*) FILTER (dist <= kth) / ({_NQ} * {K}.0::DOUBLE), 9) AS recall FROM f JOIN kth USING (query_id)")
def recall_distance_based(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    found = neighbours.ground_truth(t.points.join(t.assignment.where("shard < 4"), "id", "left_semi"), t.queries, K)
    return rounded(recall.distance_recall(found, neighbours.kth_distance(t.truth(), K), K, t.n_queries()), "recall", digits=9)


@query(f"WITH {_HITS}, e AS (SELECT unnest([50, 100]) AS ef), h AS (SELECT ef, query_id, neighbor_id FROM hits, e WHERE ef = 100 OR neighbor_id % 2 = 0), c AS (SELECT ef, query_id, least({K}, count(DISTINCT neighbor_id)) AS c FROM h GROUP BY ef, query_id) SELECT ef, round(sum(c) / ({_NQ} * {K}.0::DOUBLE), 9) AS recall FROM c GROUP BY ef")
def max_search_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    hits = t.hits().withColumn("ef", F.explode(F.array(F.lit(50), F.lit(100)))).where("ef = 100 or neighbor_id % 2 = 0")
    return rounded(recall.max_search_recall(hits, K, t.n_queries()), "recall", digits=9)


_TWO_ROUTES = f"{_HITS}, {_ROUTES}, per AS (SELECT query_id, shard, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, shard) AS probe_rank FROM truth JOIN points ON neighbor_id = id GROUP BY query_id, shard), two AS (SELECT 0 AS route_id, query_id, probe_rank, shard FROM routes UNION ALL SELECT 1, query_id, probe_rank, shard FROM per), firsts AS (SELECT route_id, b.query_id, neighbor_id FROM two b LEFT JOIN (SELECT t.query_id, t.neighbor_id, p.shard FROM truth t JOIN points p ON p.id = t.neighbor_id) n ON n.query_id = b.query_id AND n.shard = b.shard WHERE probe_rank = 1), recalls AS (SELECT route_id, round(count(neighbor_id) / (count(DISTINCT query_id) * {K}.0::DOUBLE), 9) AS recall FROM firsts GROUP BY route_id)"


def _two_routes(t: Tables) -> DataFrame:
    a = t.center_routes().select(F.lit(0).alias("route_id"), "query_id", "probe_rank", "shard")
    return a.unionByName(recall.oracle_routes(t.truth(), t.assignment).select(F.lit(1).alias("route_id"), "query_id", "probe_rank", "shard"))


@query(f"WITH {_TWO_ROUTES} SELECT route_id, recall FROM recalls")
def max_first_route_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(recall.max_first_route_recall(_two_routes(t), t.truth(), t.assignment, K), "recall", digits=9)


@query(f"WITH {_TWO_ROUTES} SELECT route_id, recall FROM recalls ORDER BY recall DESC, route_id LIMIT 1")
def best_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return recall.best_route(rounded(recall.max_first_route_recall(_two_routes(t), t.truth(), t.assignment, K), "recall", digits=9))


# ---- attribution -----------------------------------------------------------------------------------------------------

_WORK = f"cost AS (SELECT shard, count(*) AS cost FROM cover GROUP BY shard), work AS (SELECT g.p AS probes, shard, CAST(sum(cost) AS BIGINT) AS work FROM (SELECT unnest(range(1, {SHARDS} + 1)) AS p) g JOIN routes r ON r.probe_rank <= g.p JOIN cost USING (shard) GROUP BY g.p, shard)"
_ATTRIBUTION = f"{_HITS}, {_ROUTES}, {_BY_PROBES}, {_WORK}, attributed AS (SELECT probes, recall, max_work, total_work FROM by_probes JOIN (SELECT probes, max(work) AS max_work, CAST(sum(work) AS BIGINT) AS total_work FROM work GROUP BY probes) USING (probes))"
_HOSTS = "quotients AS (SELECT probes, shard, j, work / j::DOUBLE AS latency, count(*) OVER (PARTITION BY probes, j) AS shards FROM work, (SELECT unnest(range(1, 10)) AS j)), latencies AS (SELECT probes, CAST(shards + t AS BIGINT) AS hosts, latency FROM (SELECT *, row_number() OVER (PARTITION BY probes ORDER BY latency DESC, shard, j) - 1 AS t FROM quotients) WHERE t <= 8)"


@query(f"WITH {_ATTRIBUTION} SELECT CAST(probes AS INTEGER) AS probes, round(recall, 9) AS recall, max_work, total_work FROM attributed")
def attribution_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(attribution.increasing(t.center_routes(), t.hits(), t.cost(), SHARDS, K, t.n_queries()), "recall", digits=9)


@query(f"WITH {_VOTES}, pairs AS (SELECT query_id, id, shard, {_l2('v', 'qv')} AS dist FROM points, queries), truth AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM pairs) WHERE rank <= {K}), {_COVER}, kth AS (SELECT query_id, max(dist) AS kth FROM truth GROUP BY query_id), hits AS (SELECT p.query_id, c.shard, p.id AS neighbor_id FROM pairs p JOIN cover c ON p.id = c.id JOIN kth k ON p.query_id = k.query_id AND p.dist <= k.kth), b AS (SELECT query_id, least({K}, count(DISTINCT neighbor_id)) AS c FROM voted JOIN hits USING (query_id, shard) GROUP BY query_id) SELECT round((SELECT count(*) FROM voted) / {_NQ}::DOUBLE, 9) AS probes, round((SELECT sum(c) FROM b) / ({_NQ} * {K}.0::DOUBLE), 9) AS recall")
def attribution_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(attribution.variable(routing.pyramid(_voted(t)), t.hits(), K, t.n_queries()), "probes", "recall", digits=9)


@query(f"WITH {_POINTS}, {_COVER}, {_ROUTES}, {_WORK}, {_HOSTS} SELECT CAST(probes AS INTEGER) AS probes, hosts, round(latency, 6) AS latency FROM latencies")
def replica_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    work = attribution.work_by_probes(t.center_routes(), t.cost(), SHARDS)
    return rounded(attribution.replica_latency(work, 8, ["probes"]).withColumn("probes", F.col("probes").cast("int")), "latency")


_QPS = f"{_ATTRIBUTION}, {_HOSTS}, qps AS (SELECT probes, recall, hosts, latency, {_NQ} / latency AS qps_without_routing, {_NQ} / (latency + 50.0::DOUBLE / hosts) AS qps, {_NQ} / (latency + 50.0::DOUBLE / hosts) / hosts AS qps_per_host FROM latencies JOIN by_probes USING (probes))"


def _qps(t: Tables) -> DataFrame:
    routes = t.center_routes()
    latencies = attribution.replica_latency(attribution.work_by_probes(routes, t.cost(), SHARDS), 8, ["probes"])
    found = recall.recall_by_probes(routes, t.hits(), SHARDS, K, t.n_queries())
    return attribution.throughput(latencies.withColumn("probes", F.col("probes").cast("int")), t.n_queries(), 50.0).join(found, "probes")


@query(f"WITH {_QPS} SELECT CAST(probes AS INTEGER) AS probes, hosts, round(recall, 9) AS recall, round(latency, 6) AS latency, round(qps_without_routing, 9) AS qps_without_routing, round(qps, 9) AS qps, round(qps_per_host, 9) AS qps_per_host FROM qps")
def qps_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _qps(Tables(spark, sf_dir)).select("probes", "hosts", "recall", "latency", "qps_without_routing", "qps", "qps_per_host")
    return rounded(rounded(out, "recall", "qps_without_routing", "qps", "qps_per_host", digits=9), "latency")


@query(f"WITH {_QPS}, r AS (SELECT DISTINCT round(recall, 9) AS recall, round(qps, 9) AS qps FROM qps) SELECT recall, qps FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.recall >= a.recall AND b.qps >= a.qps AND (b.recall > a.recall OR b.qps > a.qps))")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.pareto_front(rounded(_qps(Tables(spark, sf_dir)).select("recall", "qps"), "recall", "qps", digits=9))


# ---- graphs ----------------------------------------------------------------------------------------------------------


@query(f"WITH {_GRAPH}, b AS (SELECT src, dst FROM graph UNION ALL SELECT dst, src FROM graph) SELECT src, dst, count(*) AS weight FROM b GROUP BY src, dst")
def symmetrize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.symmetrise(neighbours.exact_graph(Tables(spark, sf_dir).all.select("id", "vec"), K))


_BUCKETS = f"{_ALL}, bucketed AS MATERIALIZED (SELECT src, dst, CAST(r AS INTEGER) AS rank, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM (SELECT a.id AS src, b.id AS dst, {_l2('b.v', 'a.v')} AS dist FROM everything a JOIN everything b ON a.shard = b.shard AND a.id <> b.id)) WHERE r <= {K})"


@query(f"WITH {_BUCKETS} SELECT src, dst, rank, round(dist, 6) AS dist FROM bucketed")
def bucket_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).all
    return rounded(neighbours.bucket_graph(t.select("id", "vec"), t.select(F.col("shard").alias("bucket"), "id"), K), "dist")


@query(f"WITH {_BUCKETS}, {_GRAPH.replace(_ALL + ', ', '')} SELECT round(count(*) / ((SELECT count(*) FROM everything) * {K}.0::DOUBLE), 9) AS recall FROM bucketed JOIN graph USING (src, dst)")
def graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).all
    near = neighbours.bucket_graph(t.select("id", "vec"), t.select(F.col("shard").alias("bucket"), "id"), K)
    return rounded(recall.graph_recall(near, neighbours.exact_graph(t.select("id", "vec"), K), t.count(), K), "recall", digits=9)


@query(f"WITH {_GRAPH} SELECT src, dst, rank, round(dist, 6) AS dist FROM graph WHERE rank <= 4")
def degree_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.cut_degree(neighbours.exact_graph(Tables(spark, sf_dir).all.select("id", "vec"), K), 4), "dist")


@query(f"WITH {_GRAPH} SELECT count(*) FILTER (a.shard <> b.shard) AS cut, count(*) AS edges FROM graph JOIN everything a ON a.id = src JOIN everything b ON b.id = dst")
def edge_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).all
    return graphs.edge_cut(neighbours.exact_graph(t.select("id", "vec"), K), t.select("id", "shard"))


@query("WITH s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label), o AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS place FROM s) SELECT round(q / 10.0::DOUBLE, 1) AS quantile, size, round((SELECT avg(size) FROM s), 9) AS mean FROM (SELECT unnest(range(11)) AS q) JOIN o ON place = least(CAST(floor(q / 10.0::DOUBLE * (SELECT count(*) FROM s)) AS BIGINT), (SELECT count(*) FROM s) - 1)")
def bucket_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shards.degree_stats(shards.shard_sizes(Tables(spark, sf_dir).all.select("id", "shard"))), "mean", digits=9)


@query()
def sketch_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.approximate_graph(Tables(spark, sf_dir).points, K, graphs.Sketch(top_leaders=20, bucket=200, merged=100, tiny=10))


# ---- overlap and partitioning ----------------------------------------------------------------------------------------

_PGRAPH = _GRAPH.replace(_ALL, f"{_POINTS}, everything AS (SELECT * FROM points)")


@query(f"WITH {_PGRAPH}, {_COVER}, full_ AS (SELECT shard FROM cover GROUP BY shard HAVING count(*) >= (SELECT floor(1.3::DOUBLE * count(*) / 10) FROM points)), pull AS (SELECT src AS id, p.shard, count(*) AS affinity, min(rank) AS first FROM graph JOIN points p ON p.id = dst GROUP BY src, p.shard), free AS (SELECT * FROM pull WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.id = pull.id AND c.shard = pull.shard) AND shard NOT IN (SELECT shard FROM full_)) SELECT id, shard, affinity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY affinity DESC, first, shard) AS r FROM free) WHERE r = 1")
def topmove_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return overlap.top_moves(neighbours.exact_graph(t.points, K), t.assignment, t.cover, int(1.3 * t.points.count() / SHARDS))


@query(f"WITH {_POINTS}, {_CENTERS}, rated AS (SELECT id, c.shard, {_l2('c', 'v')} AS dist FROM points p JOIN centers c ON c.shard <> p.shard), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, shard) AS r FROM rated WHERE shard NOT IN (SELECT shard FROM points GROUP BY shard HAVING count(*) >= (SELECT floor(1.2::DOUBLE * count(*) / 10) FROM points))) WHERE r <= 5), fits AS (SELECT k.* FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY dist, id) AS place FROM kept) k JOIN (SELECT shard, count(*) AS n FROM points GROUP BY shard) s USING (shard) WHERE place + n <= (SELECT floor(1.2::DOUBLE * count(*) / 10) FROM points)) SELECT id, shard FROM (SELECT *, row_number() OVER (ORDER BY dist, id, shard) AS o FROM fits) WHERE o <= (SELECT floor(0.1::DOUBLE * count(*)) FROM points)")
def spann_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    n = t.points.count()
    cap = int(1.2 * n / SHARDS)
    rated = overlap.shard_ratings(t.points, centroids.centers(t.points, t.assignment), t.assignment, cap)
    return overlap.admit(rated, t.assignment, cap, int(0.1 * n))


@query()
def rkm_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    at = centroids.centers(t.points, t.assignment).orderBy("shard").collect()
    n = t.points.count()
    return centroids.evict_overloaded(t.points, t.assignment, np.array([r["vec"] for r in at]), -(-n // len(at)))


def _partition(name: str, method: str, k: int, o: float = 0.0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return methods.partition(Tables(spark, sf_dir).points, method, k, o)

    run.__name__ = name
    query()(run)


for _name, _method, _o in (
    ("gp_partition", "GP", 0.0), ("pyramid_partition", "Pyramid", 0.0), ("our_pyramid_partition", "OurPyramid", 0.0), ("balanced_kmeans", "BalancedKMeans", 0.0), ("recursive_kmeans", "KMeans", 0.0),
    ("rkm_full", "RKM", 0.0), ("ogp_full", "OGP", 0.2), ("ogps_full", "OGPS", 0.2), ("okm_full", "OKM", 0.2), ("obkm_full", "OBKM", 0.2), ("orkm_full", "ORKM", 0.2),
):
    _partition(_name, _method, 4, _o)


@query()
def hier_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.hierarchical_kmeans(Tables(spark, sf_dir).points, 0.05, rounds=5)[0]


# ---- trees and approximate search ------------------------------------------------------------------------------------

_SMALL_TREE = trees.TreeOptions(num_centroids=8, min_cluster_size=20, budget=200, search_budget=10_000, rounds=5)


@query()
def kmeans_tree_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return routing.by_distance(trees.query_trees(trees.train_trees(t.points, t.assignment, _SMALL_TREE), t.queries, _SMALL_TREE), t.shards)


@query()
def kmeans_tree_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return routing.frequency(trees.query_trees(trees.train_trees(t.points, t.assignment, _SMALL_TREE), t.queries, _SMALL_TREE, votes=20), t.shards)


@query()
def ann_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(trees.graph_search_all(t.points, t.queries, K, 100, trees.GraphOptions(m=16)), "dist")


@query()
def ann_shard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    asked = t.queries.crossJoin(F.broadcast(t.shards.withColumnRenamed("shard", "part")))  # one row for each shard
    found = trees.graph_search(search.shard_points(t.points, t.assignment), asked, K, [50, 100], trees.GraphOptions(m=16))
    return search.true_hits(found, neighbours.kth_distance(t.truth(), K)).select("ef", F.col("part").alias("shard"), "query_id", "neighbor_id")


@query()
def ef_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(sweeps.ef_sweep(t.points, t.queries, K, (20, 50, 100), trees.GraphOptions(m=16), repeats=0), "recall")


@query()
def small_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(sweeps.small_scale(t.points, t.assignment, t.queries, K, _SMALL_TREE).drop("routing_seconds"), "recall")
