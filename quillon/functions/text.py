"""Preparing texts of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.select import key_of_hex, smallest_per_group


def normal_text(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def assemble(title: Column, body: Column) -> Column:
    """Title and body on lines of their own; the body alone where there is no title."""
    blank = F.coalesce(F.trim(title), F.lit("")) == ""
    return F.trim(F.when(blank, body).otherwise(F.concat(title, F.lit("\n"), F.coalesce(body, F.lit("")))))


def priority(namespace: str, ident: Column) -> Column:
    return F.sha2(F.concat(F.lit(namespace + "|"), ident.cast("string")), 256)


def distinct_texts(rows: DataFrame, text: str, ident: str, namespace: str = "") -> DataFrame:
    """One row per normal text, that of smallest priority; null texts are left out."""
    keyed = rows.where(F.col(text).isNotNull() & F.col(ident).isNotNull()).select(F.struct(priority(namespace, F.col(ident)).alias("priority"), F.col(ident).alias("ident")).alias("s"), F.md5(normal_text(F.col(text))).alias("text_key"))
    return keyed.groupBy("text_key").agg(F.min("s").alias("s")).select(F.col("s.ident").alias(ident), F.col("s.priority").alias("priority"), "text_key")


def hash_sample(rows: DataFrame, ident: str, n: int, namespace: str = "") -> DataFrame:
    """The ``n`` ids of smallest priority: the same for any order or partitions. Null and repeated ids do not count."""
    keyed = rows.where(F.col(ident).isNotNull()).select(ident).distinct().withColumn("priority", priority(namespace, F.col(ident)))
    chosen = smallest_per_group(keyed.withColumn("_g", F.lit(0)).withColumn("_k", key_of_hex(F.col("priority"))).withColumn("_n", F.lit(n)), ["_g"], "_k", "_n", ["priority"])
    return chosen.select(ident, "priority")


def shared_texts(a: DataFrame, b: DataFrame, text: str) -> DataFrame:
    """Normal texts, by their hash, that stand on both sides; none if they are disjoint."""
    key = lambda df: df.where(F.col(text).isNotNull()).select(F.md5(normal_text(F.col(text))).alias("text_key")).distinct()
    return key(a).join(key(b), "text_key", "left_semi")


def positional_split(rows: DataFrame, order: str, calibration: int, queries: int, total: int) -> DataFrame:
    """The last rows are queries, those before calibration, the head is indexed; ``order`` is dense from 0."""
    at = F.col(order)
    return rows.withColumn("split", F.when(at >= total - queries, "queries").when(at >= total - queries - calibration, "calibration").otherwise("indexed"))


def gaps(segments: DataFrame) -> DataFrame:
    """Segments that do not begin where the one before ends; ``segment, first_row, row_count``, at most a few thousand."""
    w = Window.partitionBy(F.lit(0)).orderBy("segment")
    expected = F.coalesce(F.lag(F.col("first_row") + F.col("row_count")).over(w), F.lit(0).cast("long"))
    return segments.withColumn("expected", expected).where((F.col("expected") != F.col("first_row")) | (F.col("row_count") < 1))
