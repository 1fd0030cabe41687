"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, shared_dir  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if a file that can't be split gives it fewer; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, body): the two columns that a Python kernel needs; bodies are UTF-8 bytes, null where the text is null."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("body"))


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple[list, list]]:
    """Lists of ids and bodies, a few hundred documents at a time, so that Python objects stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
