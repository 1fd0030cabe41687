"""Points stored by shard, so that a reader of some shards reads only their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(points: DataFrame, assignment: DataFrame, path: str, files: int = 8) -> None:
    """Parquet in one folder for each shard; a shard is dealt to so many files by hash, so a large one isn't one task's."""
    own = points.join(assignment.distinct(), "id")
    own.repartition(F.col("shard"), F.pmod(F.xxhash64("id"), F.lit(files))).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    """(id, vec, shard) of the given shards, or all; others are pruned before any file is opened."""
    stored = spark.read.parquet(path).select("id", "vec", "shard")
    return stored if shards is None else stored.where(F.col("shard").isin(shards))
