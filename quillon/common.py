"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound, in bytes, on anything the engine ships to every executor by its own hand.
BROADCAST_LIMIT = 64 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; set a temporary one only in local mode.

    A cluster without that setting is refused: a folder on one machine would be lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    given = sc.getConf().get("spark.checkpoint.dir")
    if given is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="quillon-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that columns of ``df`` have already."""
    taken, free = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        free.append(name)
    return free


def is_number(column: Column) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Give a frame that sits in few files enough partitions for the kernels that follow."""
    n = parallelism(df.sparkSession)
    return df.repartition(n) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df
