"""Audit of vector lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import bad_coordinate, fault, norm
from quillon.operators.drift import nearest_rank
from quillon.spec import LEAST_NORM, MAX_NORM

#: Lengths within this of 1 count as unit (fixed value).
NEAR_UNIT = 1e-3
#: The least positive number of half precision, half of it, and its least normal number (fixed values).
HALF_LEAST = 2.0**-24
HALF_NORMAL = 2.0**-14


def flags(v: Column, dim: int) -> list[Column]:
    """Columns that tell what kind of length a vector has."""
    n = norm(v)
    finite = v.isNotNull() & (F.size(v) == dim) & (bad_coordinate(v) < 0)
    return [
        finite.alias("finite"),
        F.when(finite, n).alias("length"),
        (fault(v, dim).isNull()).alias("accepted"),
        (finite & (n > MAX_NORM)).alias("above"),
        (finite & (n < LEAST_NORM)).alias("below"),
        (finite & (n >= LEAST_NORM) & (n <= HALF_LEAST / 2)).alias("underflow"),
        (finite & (F.abs(n - 1.0) <= NEAR_UNIT)).alias("near_unit"),
        (finite & (n < HALF_NORMAL)).alias("near_zero"),
    ]


def audit(vectors: DataFrame, by: list[str], dim: int) -> DataFrame:
    """Per group: rows and how many of them are of each kind, and nearest-rank statistics of the finite lengths."""
    marked = vectors.select(*by, *flags(F.col("v"), dim))
    names = ("finite", "accepted", "above", "below", "underflow", "near_unit", "near_zero")
    counts = marked.groupBy(*by).agg(F.count("*").alias("vectors"), *(F.count_if(n).alias(n) for n in names), F.min("length").alias("length_min"), F.max("length").alias("length_max"))
    ranks = nearest_rank(["length"], (50, 95, 99), by, marked).drop("length_n")
    return counts.withColumn("non_finite", F.col("vectors") - F.col("finite")).withColumn("near_unit_share", F.when(F.col("finite") > 0, F.col("near_unit") / F.col("finite"))).join(ranks, by, "left")


def first_invalid(vectors: DataFrame, order: str, by: list[str], dim: int, n: int = 8) -> DataFrame:
    """Per group the first ``n`` rows that cannot be stored, and why."""
    bad = vectors.select(*by, order, fault(F.col("v"), dim).alias("why")).where("why IS NOT NULL").distinct()
    at = Window.partitionBy(*by).orderBy(order, "why")
    return bad.withColumn("place", F.row_number().over(at)).where(F.col("place") <= n)


def scale_shift(a: DataFrame, b: DataFrame, by: list[str], factor: float = 2.0) -> DataFrame:
    """Groups of two audits, their ratios of median and 95th percentile, and whether one leaves [1/factor, factor]."""
    left = a.select(*by, F.col("length_p50").alias("a50"), F.col("length_p95").alias("a95"))
    right = b.select(*by, F.col("length_p50").alias("b50"), F.col("length_p95").alias("b95"))
    joined = left.join(right, by).select(*by, (F.col("b50") / F.col("a50")).alias("median_ratio"), (F.col("b95") / F.col("a95")).alias("p95_ratio"))
    out = lambda c: (F.col(c) > factor) | (F.col(c) < 1 / factor)
    return joined.withColumn("shifted", out("median_ratio") | out("p95_ratio"))
