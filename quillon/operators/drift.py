"""Drift of encoded rows against what training saw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.common import fresh
from quillon.operators.select import key_of_hash, key_of_hex, smallest_per_group

#: Rows of a drift sample, the least for a warning, and its limits (fixed values).
SAMPLE = 65_536
ENOUGH = 1000
GROWTH = 1.25
EXCEEDING = 0.05


def nearest_rank(values: list[str], percents: tuple[int, ...], by: list[str], df: DataFrame) -> DataFrame:
    """Per group and for each column the values of ranks ceil(n p / 100), exactly, nulls left out.

    Equal values are counted first and ranked by running sums over distinct values, so that a group of many
    equal values stays small; a NaN ranks above all numbers.
    """
    result = None
    for v in values:
        counts = df.where(F.col(v).isNotNull()).groupBy(*by, v).agg(F.count("*").alias("_c"))
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        ranked = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(v))).withColumn("_n", F.sum("_c").over(w))
        at = lambda p, v=v: F.min(F.when(F.col("_upto") * 100 >= F.col("_n") * p, F.col(v))).alias(f"{v}_p{p}")
        part = ranked.groupBy(*by).agg(*(at(p) for p in percents), F.first("_n").alias(f"{v}_n"))
        if result is None:
            result = part
        else:
            result = result.join(part, by, "full") if by else result.crossJoin(part)  # one row each
    return result


def reservoir(df: DataFrame, key: Column, size: int = SAMPLE, by: list[str] | None = None) -> DataFrame:
    """The ``size`` rows of smallest key (``key_of_hash`` or ``key_of_hex``) per group: the same for any batching."""
    whole, own, most = fresh(df, "_all", "_key", "_most")
    base = df.withColumn(whole, F.lit(0)).withColumn(own, key).withColumn(most, F.lit(size))
    return smallest_per_group(base, by or [whole], own, most, [own]).drop(whole, own, most)


def merge_reservoirs(a: DataFrame, b: DataFrame, key: Column, size: int = SAMPLE, by: list[str] | None = None) -> DataFrame:
    """The reservoir of all rows behind two reservoirs."""
    return reservoir(a.unionByName(b).distinct(), key, size, by)


def warning(sample: Column, p95_refined: Column, exceeding: Column, baseline_p95: Column) -> Column:
    """Enough rows, and either the 95th percentile has grown by a quarter or more than a twentieth exceed the old 99th."""
    return (sample >= ENOUGH) & ((p95_refined > GROWTH * baseline_p95) | (exceeding > EXCEEDING * sample))


def report(encoded: DataFrame, baseline: dict) -> dict:
    """Quantiles of both errors, mean share outside the centers, and whether they warn, of a sample of the rows."""
    rows = reservoir(encoded.select("row_id", "err_primary", "err_refined", "outside"), key_of_hash("row_id"))
    q = nearest_rank(["err_primary", "err_refined"], (50, 95, 99), [], rows).first()
    s = rows.agg(F.count("*").alias("n"), F.avg("outside").alias("outside"), F.count_if(F.col("err_refined") > baseline["refined_p99"]).alias("exceeding")).first()
    warned = s["n"] >= ENOUGH and (q["err_refined_p95"] > GROWTH * baseline["refined_p95"] or s["exceeding"] > EXCEEDING * s["n"])
    return {k: q[k] for k in q.asDict() if "_p" in k} | {"outside": s["outside"], "sample_size": s["n"], "warned": bool(warned), "insufficient": s["n"] < ENOUGH}


__all__ = ["key_of_hash", "key_of_hex", "merge_reservoirs", "nearest_rank", "report", "reservoir", "warning"]
