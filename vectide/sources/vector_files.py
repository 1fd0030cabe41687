"""Binary vector and ground-truth files as Spark data sources, read in ranges of rows.

Register with register(spark), then spark.read.format("vectors").load(path), and "truth" likewise.
Vectors (.fbin, .u8bin, .i8bin): u32 rows, u32 dimensions, then rows of float32, uint8 or int8, little-endian. Truth: u32 queries, u32
neighbours, then all ids (u32), then all distances (float32).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {".fbin": "<f4", ".u8bin": "u1", ".i8bin": "i1"}
ROWS = 65_536  # of a partition


def vector_kind(path: str) -> np.dtype:
    ending = Path(path).suffix
    if ending not in KINDS:
        raise ValueError(f"{path}: vector files end in {', '.join(KINDS)}")
    return np.dtype(KINDS[ending])


def header(path: str) -> tuple[int, int]:
    with open(path, "rb") as f:
        found = f.read(8)
    if len(found) < 8:
        raise ValueError(f"{path}: no header")
    return struct.unpack("<II", found)


class Rows(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def _ranges(n: int, rows: int) -> list[Rows]:
    return [Rows(s, min(n, s + rows)) for s in range(0, n, rows)] or [Rows(0, 0)]


class VectorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], vector_kind(options["path"])
        n, self.d = header(self.path)
        self.n = min(n, int(options.get("size", n)))
        self.rows = int(options.get("rows", ROWS))
        if os.path.getsize(self.path) < 8 + n * self.d * self.kind.itemsize:
            raise ValueError(f"{self.path}: shorter than its header says")

    def partitions(self) -> list[Rows]:
        return _ranges(self.n, self.rows)

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(8 + partition.start * self.d * self.kind.itemsize)
            values = np.fromfile(f, self.kind, (partition.end - partition.start) * self.d).astype(np.float32)
        offsets = np.arange(0, len(values) + 1, self.d, dtype=np.int32) if self.d else np.zeros(1, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.start, partition.end)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "vec"])


class VectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "id long, vec array<float>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options)


class TruthReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))
        self.n, self.k = header(self.path)

    def partitions(self) -> list[Rows]:
        return _ranges(self.n, self.rows)

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        count = (partition.end - partition.start) * self.k
        with open(self.path, "rb") as f:
            f.seek(8 + 4 * partition.start * self.k)
            ids = np.fromfile(f, "<u4", count)
            f.seek(8 + 4 * self.n * self.k + 4 * partition.start * self.k)
            dist = np.fromfile(f, "<f4", count)
        queries = np.repeat(np.arange(partition.start, partition.end), self.k)
        rank = np.tile(np.arange(1, self.k + 1, dtype=np.int32), partition.end - partition.start)
        yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(rank), pa.array(ids.astype(np.int64)), pa.array(dist.astype(float))], names=["query_id", "rank", "neighbor_id", "dist"])


class TruthSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "truth"

    def schema(self) -> str:
        return "query_id long, rank int, neighbor_id long, dist double"

    def reader(self, schema) -> TruthReader:
        return TruthReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorSource)
    spark.dataSource.register(TruthSource)


def read_points(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """points(id, vec); only the first size rows, whatever the file's kind."""
    vector_kind(path)
    register(spark)
    reader = spark.read.format("vectors")
    return (reader.option("size", size) if size is not None else reader).load(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("truth").load(path)


def write_points(points: DataFrame, path: str) -> None:
    """One .fbin file, by id. Rows are streamed in order, so the driver holds a partition at a time."""
    if vector_kind(path) != np.dtype("<f4"):
        raise ValueError("points are written as .fbin")
    n, d = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    with open(path, "wb") as f:
        f.write(struct.pack("<II", n, d))
        for r in points.orderBy("id").select("vec").toLocalIterator():
            np.asarray(r["vec"], "<f4").tofile(f)


def write_truth(truth: DataFrame, path: str) -> None:
    """One file, by query and rank; all queries must have as many neighbours."""
    per = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("k"))
    n, low, high = per.agg(F.count(F.lit(1)), F.coalesce(F.min("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
    if low != high:
        raise ValueError("queries have different numbers of neighbours")
    ordered = truth.orderBy("query_id", "rank")
    with open(path, "wb") as f:
        f.write(struct.pack("<II", n, high))
        for column, kind in (("neighbor_id", "<u4"), ("dist", "<f4")):
            for r in ordered.select(column).toLocalIterator():
                f.write(np.asarray(r[0], kind).tobytes())
