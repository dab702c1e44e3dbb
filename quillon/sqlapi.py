"""Functions of the engine under names that SQL can call."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.functions import codec
from quillon.functions.codec import Model
from quillon.operators.blocks import matrix
from quillon.plans.index import Index


def register(spark: SparkSession, model: Model) -> None:
    """``rotate(v)``, ``unrotate(y)``, ``int4_encode(y)``, ``pq_encode(r)`` of a model, and SQL functions
    ``vec_norm(v)``, ``dot(a, b)``, ``cosine_sim(a, b)``; null vectors give null."""

    def vectorised(kind, run):
        @F.pandas_udf(kind)
        def f(v: pd.Series) -> pd.Series:
            made = iter(run(matrix(v[v.notna()], model.spec.dim)))
            return pd.Series([next(made) if there else None for there in v.notna()], dtype=object)

        return f

    spark.udf.register("rotate", vectorised("array<float>", lambda x: model.rotation.forward(codec.directions(x))))
    spark.udf.register("unrotate", vectorised("array<float>", model.rotation.inverse))
    spark.udf.register("int4_encode", vectorised("array<int>", lambda y: codec.encode_centers(y, model.centers).astype(np.int32)))
    spark.udf.register("pq_encode", vectorised("array<int>", lambda r: codec.encode_residual(r, model.codebook).astype(np.int32)))
    products = "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {products}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_norm(v ARRAY<FLOAT>) RETURNS DOUBLE RETURN sqrt(aggregate(v, 0D, (s, x) -> s + double(x) * double(x)))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_sim(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {products} / (sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x))) * sqrt(aggregate(b, 0D, (s, x) -> s + double(x) * double(x))))")


def register_index(spark: SparkSession, name: str, path: str, queries: str, k: int = 10, metric: str = "cosine") -> None:
    """A view ``name`` of the hits of the table ``queries`` (``query_id, v``) in an index, and a table function
    ``name_of(query_id, most)`` of the best of one query's hits."""
    Index.open(spark, path).search(spark.table(queries), k, metric=metric).createOrReplaceTempView(name)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_of(q BIGINT, most INT) RETURNS TABLE (row_id BIGINT, rank INT, score DOUBLE, lower DOUBLE, upper DOUBLE) "
        f"RETURN SELECT h.row_id, h.rank, h.score, h.lower, h.upper FROM {name} h WHERE h.query_id = q AND h.rank <= most"
    )
