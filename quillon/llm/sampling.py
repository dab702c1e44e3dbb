"""A sample that is the same in every rerun and only ever grows (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.common import fresh
from quillon.operators.select import KEY_BITS, key_of_hex, smallest_per_group


def canonical_id(column: Column) -> Column:
    """The 32 lower-case hex digits that a spelling of 16 bytes stands for; null if it stands for none.

    Accepted besides plain digits of either case: outer blanks, dashes, braces, and the prefixes ``0x`` and
    ``urn:uuid:``.
    """
    plain = F.regexp_replace(F.lower(F.trim(column)), r"^(urn:uuid:|0x)|[-{}\s]", "")
    return F.when(plain.rlike("^[0-9a-f]{32}$"), plain)


def true_priority(row_id: Column, index_id: Column) -> Column:
    """SHA-256, in hex, of the row id as 8 little-endian bytes and the 16 bytes of the index id (its salt)."""
    big = F.lpad(F.hex(row_id), 16, "0")
    little = F.concat(*(F.substring(big, i, 2) for i in range(15, 0, -2)))
    return F.sha2(F.unhex(F.concat(little, index_id)), 256)


def frozen_batches(rows: DataFrame, sample: str, batch: str, key: str, rate: str, ties: list[str]) -> DataFrame:
    """Frozen batch bottom-k: of each arrival batch, the ceil(rate x size) rows with the smallest keys.

    ``sample`` names the column of the sample a row is meant for, ``batch`` that of its arrival batch,
    ``rate`` one with the share to keep, in [0, 1]. A batch's choice depends on its own rows alone, so a later
    batch never removes a row: the sample is the union of its batches.

    Rows of null key or rate are left out; a null sample or batch is a sample or batch of its own; a batch of
    rate 0 keeps nothing; repeated rows are the caller's to remove. Ties are ordered by ``ties``.
    """
    quota, s, b = fresh(rows, "_quota", "_s", "_b")
    whole = rows.where(F.col(key).isNotNull() & F.col(rate).isNotNull())
    sizes = whole.groupBy(F.col(sample).alias(s), F.col(batch).alias(b)).agg(
        # the share is rounded to 1e-9 first, or 0.07 * 100 would ask for 8 rows
        F.ceil(F.round(F.max(rate) * F.count("*"), 9)).alias(quota)
    )
    joined = whole.join(sizes, on=[whole[sample].eqNullSafe(sizes[s]), whole[batch].eqNullSafe(sizes[b])]).drop(s, b)
    return smallest_per_group(joined, [sample, batch], key, quota, ties).drop(quota)


def shown_rows(drift_rows: DataFrame, drift_indexes: DataFrame) -> DataFrame:
    """Each row that an index was shown, once: ``index_id, row_id, generation, permille, priority, key, rate``.

    Left out are rows of unknown or null index and those without row id. ``generation`` is the first one in
    which the row came (of null generations only: -1). The priority is computed anew: what the rows declare
    is not reliable.
    """
    known = drift_indexes.select(canonical_id(F.col("index_id")).alias("_id"), "index_id", F.col("sample_permille").alias("permille"))
    shown = (
        drift_rows.where(F.col("row_id").isNotNull())
        .select(canonical_id(F.col("index_id")).alias("_id"), "row_id", "generation")
        .where(F.col("_id").isNotNull())
        .groupBy("_id", "row_id")
        .agg(F.coalesce(F.min("generation"), F.lit(-1)).alias("generation"))
    )
    return (
        shown.join(known, "_id")
        .withColumn("priority", true_priority(F.col("row_id"), F.col("_id")))
        .withColumn("key", key_of_hex(F.col("priority")))
        .withColumn("rate", F.col("permille") / 1000.0)
        .drop("_id")
    )


def threshold_sample(drift_rows: DataFrame, drift_indexes: DataFrame) -> DataFrame:
    """The rows whose priority lies under their index's rate.

    Bottom-k cannot give this sample, whose size is left to chance: a batch's share of smallest keys is a fixed
    number. It is the limit that ``frozen_batches`` approaches as batches grow, and as append-only: a row's own
    priority decides.
    """
    return shown_rows(drift_rows, drift_indexes).where(F.col("key") * 1000 < F.col("permille") * F.lit(1 << KEY_BITS))


def sample_growth(drift_rows: DataFrame, drift_indexes: DataFrame) -> DataFrame:
    """Per index and generation: rows seen in it, rows its batch adds to the sample, and both running totals."""
    shown = shown_rows(drift_rows, drift_indexes)
    seen = shown.groupBy("index_id", "generation").agg(F.count("*").alias("batch_seen"))
    kept = frozen_batches(shown, "index_id", "generation", "key", "rate", ["row_id"])
    drawn = kept.groupBy("index_id", "generation").agg(F.count("*").alias("batch_sampled"))
    so_far = Window.partitionBy("index_id").orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    return (
        seen.join(drawn, ["index_id", "generation"], "left")
        .withColumn("batch_sampled", F.coalesce("batch_sampled", F.lit(0).cast("long")))
        .withColumn("seen_count", F.sum("batch_seen").over(so_far))
        .withColumn("sample_size", F.sum("batch_sampled").over(so_far))
    )


def growth_and_commits(drift_rows: DataFrame, drift_indexes: DataFrame, drift_commits: DataFrame) -> DataFrame:
    """The published running totals beside those counted: ``index_id, generation, published_seen, seen_count,
    published_size, threshold_size, batch_size``, and ``seen_agrees``.

    ``published_size`` is that of the sample by threshold, ``batch_size`` that of the frozen batches, which hold at
    least as many on average, at most one more a batch. Null generations and unknown indexes are left out, of
    several commits of a generation the last counts (then the larger numbers); null counts stay null and agree with
    nothing.
    """
    shown = shown_rows(drift_rows, drift_indexes)
    under = F.col("key") * 1000 < F.col("permille") * F.lit(1 << KEY_BITS)
    so_far = Window.partitionBy("index_id").orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        shown.groupBy("index_id", "generation").agg(F.count("*").alias("_n"), F.count_if(under).alias("_u"), F.ceil(F.round(F.max("rate") * F.count("*"), 9)).alias("_q"))
        .select("index_id", "generation", F.sum("_n").over(so_far).alias("seen_count"), F.sum("_u").over(so_far).alias("threshold_size"), F.sum("_q").over(so_far).alias("batch_size"))
    )
    known = drift_indexes.select(canonical_id(F.col("index_id")).alias("_id"), F.col("index_id").alias("_name"))
    published = (
        drift_commits.where(F.col("generation").isNotNull())
        .select(canonical_id(F.col("index_id")).alias("_id"), "generation", F.struct("committed_at", F.col("seen_count").alias("seen"), F.col("sample_size").alias("size")).alias("_c"))
        .join(known, "_id")
        .groupBy(F.col("_name").alias("index_id"), "generation")
        .agg(F.max("_c").alias("_c"))
    )
    return published.join(counted, ["index_id", "generation"], "left").select(
        "index_id", "generation", F.col("_c.seen").cast("double").alias("published_seen"), "seen_count", F.col("_c.size").cast("double").alias("published_size"), "threshold_size", "batch_size",
        F.coalesce(F.col("_c.seen") == F.col("seen_count"), F.lit(False)).alias("seen_agrees"),
    )
