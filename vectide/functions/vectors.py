"""Vector functions as Columns over array columns. Sums run left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("l2", "mips")
TINY = 1e-10  # squared norms below are not normalised


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return metric


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def inner_product(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def mips_distance(a: Column, b: Column) -> Column:
    """1 - <a, b>; may be negative."""
    return F.lit(1.0) - inner_product(a, b)


def squared_norm(v: Column) -> Column:
    return _total(F.transform(v, lambda x: x * x))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    return squared_l2(a, b) if check_metric(metric) == "l2" else mips_distance(a, b)


def positive_distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """distance, moved so that unit vectors under mips are never negative."""
    return squared_l2(a, b) if check_metric(metric) == "l2" else mips_distance(a, b) + 1.0


def can_normalise(v: Column) -> Column:
    return squared_norm(v) >= TINY


def normalise(v: Column) -> Column:
    """v / |v|; vectors that are nearly zero stay as they are."""
    return F.when(can_normalise(v), F.transform(v, lambda x: x / F.sqrt(squared_norm(v)))).otherwise(v)


def nearly_equal(x: Column, y: Column, eps: float = 1e-12) -> Column:
    return F.abs(x - y) < eps


def unrolled_distance(a: str, b: str, d: int, metric: str = "l2") -> Column:
    """distance over element accesses: whole-stage code instead of array functions, for few dimensions."""
    x, y = (lambda i: F.col(a)[i]), (lambda i: F.col(b)[i])
    terms = [(x(i) - y(i)) * (x(i) - y(i)) if check_metric(metric) == "l2" else x(i) * y(i) for i in range(d)]
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total if metric == "l2" else F.lit(1.0) - total


def chunk_of(position: Column, total: Column, chunks: int) -> Column:
    """Which of so many equal ranges, each of ceil(total / chunks), a position from 0 lies in."""
    return F.floor(position / F.ceil(total / F.lit(chunks))).cast("int")


def norm_audit(points: DataFrame, eps: float = 1e-6) -> DataFrame:
    """One row: how many vectors are of unit length before and after normalising."""
    unit = lambda v: F.abs(squared_norm(v) - 1.0) < eps
    return points.select(F.col("vec"), normalise(F.col("vec")).alias("to")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(unit(F.col("vec"))).alias("unit_before"), F.count_if(unit(F.col("to"))).alias("unit_after")
    )
