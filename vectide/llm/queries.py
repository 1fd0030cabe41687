"""The queries of this subpackage, each over its whole table, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_search, html_extract, license_scan, line_dedup, ngram_join, packing, quality_rules, secret_scan, sp_tokenizer, toxicity
from .common import spread, table

SP_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spread(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spread(table(spark, sf_dir, "documents")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(spread(table(spark, sf_dir, "documents")), n=4, percent=85)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = SP_MODEL) -> DataFrame:
    return sp_tokenizer.encode(spread(table(spark, sf_dir, "documents")), model_path)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.nearest(table(spark, sf_dir, "embeddings"))


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(min(r.y) AS BIGINT) AS component_id
FROM sets s JOIN reach r ON s.doc_id = r.x GROUP BY s.doc_id, s.s
"""

OP6_SQL = r"""
WITH lined AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), windows AS (
  SELECT doc_id, p, ls[p + 1] || chr(10) || ls[p + 2] || chr(10) || ls[p + 3] AS w
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS p FROM lined WHERE len(ls) >= 3)
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM windows WHERE regexp_matches(w, '[^\x20\x09-\x0D]')
), gone AS (
  SELECT doc_id, list(DISTINCT q) AS g FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM ranked WHERE r > 1) GROUP BY doc_id
)
SELECT l.doc_id, CASE WHEN g IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(g, i)), lambda i: ls[i + 1]), chr(10)), '') END AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed
FROM lined l LEFT JOIN gone USING (doc_id)
"""


def queries() -> dict[str, Query]:
    found = (op1_quality_rules, op2_secret_scan, op3_best_fit_packing, op4_license_scan, op5_ngram_join, op6_line_dedup, op7_sentencepiece, op8_html_extract, op9_toxicity, op10_ann_search)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_join": OP5_SQL, "op6_line_dedup": OP6_SQL}
