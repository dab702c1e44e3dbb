"""Searching all rows for many queries, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.common import parallelism

#: Rows and queries, about, of one task.
SHARD_ROWS = 16_384
QUERY_ROWS = 16_384


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float32) if len(column) else np.zeros((0, dim), np.float32)


def bytes_matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, width)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the lower id."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        pool = np.flatnonzero(scores >= limit)
    else:
        pool = np.arange(len(scores))
    return pool[np.lexsort((ids[pool], -scores[pool]))][:k]


def shard(index: DataFrame, queries: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, rows: int | None = None, asked: int | None = None) -> DataFrame:
    """Meets every row of ``index`` (by ``row_id``) with every query (by ``query_id``), a block of each per task.

    Rows are sent once per block of queries, queries once per shard of rows; neither side is broadcast, and no
    pair of a row and a query ever becomes a row of a table. ``kernel`` sees one block of each and returns what
    it keeps.
    """
    rows = index.count() if rows is None else rows
    asked = queries.count() if asked is None else asked
    shards = max(1, -(-rows // SHARD_ROWS), min(parallelism(index.sparkSession), -(-rows // 1024)))
    blocks = max(1, -(-asked // QUERY_ROWS))
    own_shard, own_block = F.pmod(F.xxhash64("row_id"), F.lit(shards)), F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    left = index.withColumn("_shard", own_shard).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = queries.withColumn("_block", own_block).withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) and len(b):
            return kernel(a.sort_values("row_id", ignore_index=True), b.sort_values("query_id", ignore_index=True))[columns]
        return pd.DataFrame(columns=columns)

    return left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInPandas(run, schema)


def merge(found: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The best k of each query from the bests of the shards, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def batched(rows: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    for a in range(0, len(rows), size):
        yield rows.iloc[a : a + size]
