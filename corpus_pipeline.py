"""A corpus pipeline: quality rules, line dedup, near duplicates, secrets, packing. See run().

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it back as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import line_dedup, ngram_join, packing, quality_rules, secret_scan
from vectide.llm.common import materialize, table


def _recounted(docs: DataFrame, text: DataFrame) -> DataFrame:
    """text with the columns of docs, and n_chars of the new texts."""
    out = text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else text
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or that the rules find bad go.

    Null and empty texts fail the limits. Rows that repeat an id and rows without one are judged one by one, very long texts as a
    whole; an empty table gives an empty one.
    """
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of three or more lines that stand earlier go; the documents stay.

    Null and empty texts stay as they are. Rows that repeat an id, or have none, keep the places that line_dedup states; very
    long texts count as a whole; an empty table gives an empty one.
    """
    return _recounted(docs, line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links by Jaccard similarity of 0.8 over five-word shingles, the document with the smallest id stays.

    Rows that repeat an id are one document of the group if they link; rows of one id and one text stay once, other texts of the id stay
    too. Rows without an id stay, as they take no part. Null and empty texts link with nothing. An empty table gives an empty one.
    """
    labels = ngram_join.ngram_components(docs, n=5, percent=80)
    rest = labels.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # of rows of one id and text the first by all columns; which it is doesn't depend on the order of rows, and they are dealt by id already
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = docs.where("doc_id is not null").join(rest, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("rest"))
    one = one.select("doc_id", "text", *[F.col("rest").getField(c).alias(c) for c in others])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked; the documents stay.

    Null and empty texts, rows that repeat an id and rows without one stay; very long texts are read as a whole; an empty table gives an empty one.
    """
    return _recounted(docs, secret_scan.mask(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies.

    Null and empty texts have a piece of no words; long texts have several pieces; rows that repeat an id and rows without one are packed
    one by one; an empty table gives an empty one.
    """
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("best-fit packing", packed)]

# EM weights and compressed sizes are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents table; each result is written in the shared folder. Nulls and odd rows: as the stages say."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
