"""Selecting the smallest keys of every group without collecting or sorting a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.common import fresh

#: Keys are integers in [0, 2^KEY_BITS).
KEY_BITS = 52
#: Leading bits of a key that form its histogram bucket.
BUCKET_BITS = 12


def key_of_hex(digits: Column) -> Column:
    """The first 13 hex digits of a hash as a key."""
    return F.conv(F.substring(digits, 1, KEY_BITS // 4), 16, 10).cast("long")


def key_of_hash(*columns: Column) -> Column:
    """A key from a 64-bit hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - KEY_BITS)


def key_of_fraction(column: Column) -> Column:
    """A key that keeps the order of fractions in [0, 1]."""
    return F.least((column * F.lit(float(1 << KEY_BITS))).cast("long"), F.lit((1 << KEY_BITS) - 1))


def smallest_per_group(
    df: DataFrame, by: list[str], key: str, quota: str, ties: list[str], weight: str | None = None, bucket_bits: int = BUCKET_BITS
) -> DataFrame:
    """Rows with the smallest keys of each group, as many as the group's quota.

    ``key`` holds longs in [0, 2^52) that are spread about evenly (hashes), ``quota`` a number that is the
    same in all rows of a group, ``ties`` columns that order rows of equal key. Without ``weight`` exactly
    min(quota, size) rows remain. With ``weight`` (numbers of 0 or more) rows are taken in key order as long
    as the weight before them plus half their own stays below the quota, so that the sum ends within half a
    row of it.

    A histogram over the leading bits of the key, at most 2^bucket_bits rows a group, finds the bucket in
    which the quota is met. Rows of earlier buckets are kept unranked; only that one bucket is ranked. So a
    group of any size, a third of all rows included, is never sorted as a whole: a task ranks about
    size / 2^bucket_bits rows.

    Null groups form a group of their own; rows of null key or quota are left out. An empty frame gives an
    empty frame.
    """
    own, at, edge_, *groups = fresh(df, "_own", "_at", "_edge", *(f"_g{i}" for i in range(len(by))))
    size = F.lit(1).cast("double") if weight is None else F.col(weight).cast("double")
    rows = df.where(F.col(key).isNotNull() & F.col(quota).isNotNull())
    bucket = F.shiftright(F.col(key), KEY_BITS - bucket_bits)
    counts = (
        rows.groupBy(*(F.col(c).alias(g) for c, g in zip(by, groups)), bucket.alias("_bucket"))
        .agg(F.sum(size).alias("_w"), F.max(F.col(quota).cast("double")).alias("_quota"))
    )
    upto = F.sum("_w").over(Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    edges = (
        counts.withColumn("_upto", upto)
        .where(F.col("_upto") >= F.col("_quota"))
        .groupBy(*groups)
        .agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_w")).alias("before"), "_quota")).alias(edge_))
    )
    same = [rows[c].eqNullSafe(edges[g]) for c, g in zip(by, groups)]
    joined = rows.withColumn(own, bucket).join(edges, on=same, how="left")
    below = joined.where(F.col(edge_).isNull() | (F.col(own) < F.col(f"{edge_}._bucket"))).select(*df.columns)
    edge = joined.where(F.col(own) == F.col(f"{edge_}._bucket"))
    ordered = Window.partitionBy(*groups).orderBy(key, *ties)
    if weight is None:
        ranked = edge.withColumn(at, F.row_number().over(ordered) - F.lit(1.0))
    else:
        ranked = edge.withColumn(at, F.sum(size).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - size / 2)
    taken = F.col(f"{edge_}.before") + F.col(at) < F.col(f"{edge_}._quota")
    return below.unionByName(ranked.where(taken).select(*df.columns))
