"""Training a model: tables on the driver's bounded sample, sub-quantisers in parallel tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.common import cut
from quillon.errors import InvalidTraining
from quillon.functions import codec
from quillon.functions.codec import Model
from quillon.operators.blocks import matrix
from quillon.spec import LEAST_TRAINING, MAX_TRAINING, CodecSpec, default_validation


def train(x: np.ndarray, spec: CodecSpec, seed: int, validation: int | None = None, spark: SparkSession | None = None) -> Model:
    """A model from at most MAX_TRAINING valid rows. With ``spark`` each sub-quantiser is a task of its own.

    The model's ``baseline`` holds the errors of the validation rows and how much work the sub-quantisers took
    (``training_iterations, training_moves, training_reseeds``, over all of them)."""
    validation = default_validation(len(x)) if validation is None else validation
    rotation, centers, residuals, held = codec.train_tables(x, spec, seed, validation)
    sub = spec.sub
    if spark is None:
        books, said = zip(*(codec.kmeans(residuals[:, s * sub : (s + 1) * sub], spec.centroids, [seed, s]) for s in range(spec.subs)))
        work = {k: sum(x[k] for x in said) for k in ("iterations", "moves", "reseeds")}
    else:
        shared = spark.sparkContext.broadcast(residuals)  # at most MAX_TRAINING rows

        def run(batches):
            for part in batches:
                for s in part["id"].tolist():
                    book, said = codec.kmeans(shared.value[:, s * sub : (s + 1) * sub], spec.centroids, [seed, s])
                    yield pd.DataFrame([(s, book.tobytes(), said["iterations"], said["moves"], said["reseeds"])], columns=["sub", "book", "iterations", "moves", "reseeds"])

        made = spark.range(0, spec.subs, 1, spec.subs).mapInPandas(run, "sub long, book binary, iterations int, moves int, reseeds int").toPandas().sort_values("sub")
        books = [np.frombuffer(b, np.float32).reshape(-1, sub) for b in made.book]
        work = {k: int(made[k].sum()) for k in ("iterations", "moves", "reseeds")}
    model = Model(spec, rotation, centers, np.stack(books), {})
    codes, res, p, e = codec.encode(held, model)
    primary, refined, outside = codec.errors(held, p, e, centers)
    rank = lambda v, q: float(np.sort(v)[max(0, -(-len(v) * q // 100) - 1)])
    baseline = {f"{n}_p{q}": rank(v, q) for n, v in (("primary", primary), ("refined", refined)) for q in (50, 95, 99)} | {"outside": float(outside.mean())} | {f"training_{k}": int(v) for k, v in work.items()}
    return Model(spec, rotation, centers, np.stack(books), baseline)


def training_matrix(rows: DataFrame, order: str, spec: CodecSpec) -> np.ndarray:
    """The training rows ``order, v`` on the driver, at most MAX_TRAINING of them."""
    some = rows.select(order, "v").limit(MAX_TRAINING + 1).toPandas().sort_values(order)
    if not LEAST_TRAINING < len(some) <= MAX_TRAINING:
        raise InvalidTraining(f"{len(some)} training rows; more than {LEAST_TRAINING} and at most {MAX_TRAINING} are needed")
    return matrix(some.v, spec.dim)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Integers of the same order as the numbers; -0 is 0, NaN above all."""
    bits = np.where(np.isnan(x), np.float32(np.nan), x + np.float32(0)).astype(np.float32).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits)


def _number(value: int) -> float:
    x = float(np.int32(abs(value)).view(np.float32))
    return -x if value < 0 else x


def centers_of(rows: DataFrame, spec: CodecSpec) -> DataFrame:
    """``coord, code, center``: ``codec.quantile_centers`` of any number of rows ``v``, exactly.

    A first pass counts values by their leading 16 bits, at most 65,536 buckets a coordinate, which gives the
    buckets that hold the ranks; a second counts single values in those, again at most 65,536 a bucket. On the driver
    there are only the ranks, one per center.
    """
    spark, dim = rows.sparkSession, spec.dim

    def count(bucket_of):
        def run(batches):
            for part in batches:
                ordered = _ordered(matrix(part.v, dim))
                for c in range(dim):
                    values, n = np.unique(bucket_of(c, ordered[:, c]), return_counts=True)
                    yield pd.DataFrame({"coord": c, "value": values, "n": n})

        return rows.select("v").mapInPandas(run, "coord int, value long, n long").groupBy("coord", "value").agg(F.sum("n").alias("n"))

    def at_rank(counts: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy("value"))
        placed = counts.withColumn("upto", upto).join(F.broadcast(ranks), by)
        return placed.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))

    buckets = cut(count(lambda c, v: v >> 16))
    codes = F.explode(F.sequence(F.lit(0), F.lit(spec.centers - 1))).alias("code")
    ranks = buckets.groupBy("coord").agg(F.sum("n").alias("all")).select("coord", "all", codes)
    ranks = ranks.select("coord", "code", F.expr(f"code * (all - 1) div {spec.centers - 1}").alias("rank"))
    held = at_rank(buckets, ["coord"], ranks).select("coord", "code", F.col("value").alias("bucket"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).toPandas()
    wanted = {c: np.unique(b) for c, b in held.groupby("coord").bucket}
    single = count(lambda c, v: v[np.isin(v >> 16, wanted.get(c, ()))]).withColumn("bucket", F.shiftright("value", 16))
    found = at_rank(single, ["coord", "bucket"], spark.createDataFrame(held, "coord int, code int, bucket long, rank long")).select("coord", "code", "value")
    return spark.createDataFrame([(r.coord, r.code, _number(r.value)) for r in found.collect()], "coord int, code int, center float")
