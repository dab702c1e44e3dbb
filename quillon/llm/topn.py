"""The best items of every group (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.common import is_number


def top_n(rows: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """``group, ident, score, rank`` of each group's ``n`` items of highest score, ties to the lower ident.

    Null, NaN and infinite scores are no scores; rows of null group or ident are left out. An item counts once
    in its group, with its highest score. A group of fewer items comes out whole.

    Repeated rows are merged by (group, ident), which spreads even a group that holds a third of all rows over
    all tasks. ``row_number() <= n`` then lets the optimiser put a group limit before the shuffle by group and
    another after it, so that a task receives at most n rows of a group from each of the tasks before.
    """
    best = (
        rows.where(is_number(F.col(score)) & F.col(group).isNotNull() & F.col(ident).isNotNull())
        .groupBy(group, ident)
        .agg(F.max(F.col(score) + F.lit(0.0)).alias(score))
    )
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc(ident))
    return best.select(group, ident, score, F.row_number().over(order).alias("rank")).where(F.col("rank") <= n)


def best_lists(candidates: DataFrame, neighbors: DataFrame, n: int = 10) -> DataFrame:
    """The top ``n`` of both lists of each query: ``list_name, query_id, row_id, score, rank``."""
    a = top_n(candidates, "query_id", "corrected", "row_id", n).withColumnRenamed("corrected", "score")
    b = top_n(neighbors, "query_id", "score", "row_id", n)
    return a.select(F.lit("candidates").alias("list_name"), "*").unionByName(b.select(F.lit("neighbors").alias("list_name"), "*"))
