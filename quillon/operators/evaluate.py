"""Measuring search against truth: recall, losses, rank gaps, pruning, relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.common import is_number
from quillon.operators.drift import nearest_rank


def unique_scores(rows: DataFrame, score: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per query and row with a usable score, the highest where there are several."""
    ok = rows.where(is_number(F.col(score)) & F.col("query_id").isNotNull() & F.col("row_id").isNotNull())
    return ok.groupBy("query_id", "row_id").agg(F.max(score).alias(score), *(F.max(c).alias(c) for c in keep))


def ranked(rows: DataFrame, score: str, name: str = "rank", most: int | None = None) -> DataFrame:
    """Rows with their rank per query by descending score, ties to the lower row; only the first ``most``."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "row_id")))
    return out if most is None else out.where(F.col(name) <= most)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query of the truth: hits among its true k, how many of those there are, and their ratio; never padded.

    Both sides have ``query_id, row_id, rank``.
    """
    true_k, found_k = truth.where(F.col("rank") <= k).select("query_id", "row_id"), found.where(F.col("rank") <= k).select("query_id", "row_id")
    hit = found_k.distinct().withColumn("hit", F.lit(1).cast("long"))
    return (
        true_k.join(hit, ["query_id", "row_id"], "left")
        .groupBy("query_id")
        .agg(F.coalesce(F.sum("hit"), F.lit(0).cast("long")).alias("hits"), F.count("*").alias("wanted"))
        .withColumn("recall", F.col("hits") / F.col("wanted"))
    )


def budget_sweep(candidates: DataFrame, truth: DataFrame, k: int, budgets: list[int]) -> DataFrame:
    """Total hits of the true k if only the first B candidates by primary score are kept, per budget.

    ``candidates`` has ``primary_raw`` and ``corrected``; the pool is ranked by the latter.
    """
    pool = ranked(candidates, "primary_raw", "primary_rank", max(budgets))
    each = pool.withColumn("budget", F.explode(F.array(*(F.lit(b) for b in budgets)))).where(F.col("primary_rank") <= F.col("budget"))
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("budget", "query_id").orderBy(F.desc("corrected"), "row_id"))).where(F.col("rank") <= k)
    true_k = truth.where(F.col("rank") <= k).select("query_id", "row_id")
    hits = top.join(true_k, ["query_id", "row_id"]).groupBy("budget").agg(F.count("*").alias("hits"))
    base = candidates.sparkSession.createDataFrame([(b,) for b in budgets], "budget int").join(true_k.agg(F.count("*").alias("wanted")))
    return base.join(hits, "budget", "left").select("budget", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), "wanted")


def loss_attribution(candidates: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Where each query loses true neighbours: not selected, or selected and ranked out, by kind of score.

    Per query with truth: ``wanted``, ``selected`` (true rows in the pool), and how many of those are among the
    first k by the corrected, the refined and the true score; ``selection_losses`` = wanted - selected and
    ``ranking_losses`` = selected - delivered.
    """
    order = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "row_id"))
    kinds = ("corrected", "refined_raw", "truth_score")
    pool = candidates.select("query_id", "row_id", *((order(c) <= k).cast("long").alias(c) for c in kinds))
    true_k = truth.where(F.col("rank") <= k).select("query_id", "row_id")
    none = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return (
        true_k.join(pool, ["query_id", "row_id"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("wanted"), F.count("corrected").alias("selected"), none("corrected").alias("delivered"), none("refined_raw").alias("by_refined"), none("truth_score").alias("by_truth"))
        .withColumn("selection_losses", F.col("wanted") - F.col("selected"))
        .withColumn("ranking_losses", F.col("selected") - F.col("delivered"))
    )


#: Range of lengths that one byte can tell apart (fixed values).
BYTE_RANGE = (0.5, 1.25)


def as_half(x: Column) -> Column:
    """A positive number rounded to half precision, ties to even."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(x)), F.lit(-14)) - 10)
    return F.bround(x / step) * step


def as_byte(x: Column) -> Column:
    """A length rounded to one of 256 steps of BYTE_RANGE."""
    low, high = BYTE_RANGE
    step = (high - low) / 255
    return F.bround((F.least(F.greatest(x, F.lit(low)), F.lit(high)) - low) / step) * step + low


def stored_alignment(candidates: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """True neighbours among the first k per query if the length that corrects scores is kept exactly, in half
    precision, in one byte, or not at all. A length that is no positive number corrects nothing."""
    length = F.when(is_number(F.col("recon_length")) & (F.col("recon_length") > 0), F.col("recon_length"))
    kinds = {"exact": length, "half": as_half(length), "byte": as_byte(length), "none": F.lit(1.0)}
    scored = candidates.where(F.col("refined_raw").isNotNull()).select("query_id", "row_id", *((F.col("refined_raw") / F.coalesce(v, F.lit(1.0))).alias(f"by_{n}") for n, v in kinds.items()))
    order = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "row_id"))
    placed = scored.select("query_id", "row_id", *((order(f"by_{n}") <= k).cast("long").alias(f"by_{n}") for n in kinds))
    true_k = truth.where(F.col("rank") <= k).select("query_id", "row_id")
    return true_k.join(placed, ["query_id", "row_id"], "left").groupBy("query_id").agg(*(F.coalesce(F.sum(f"by_{n}"), F.lit(0).cast("long")).alias(f"by_{n}") for n in kinds))


#: The kinds of rank in a loss trace.
TRACE = ("by_primary", "by_refined", "by_corrected", "by_stored", "by_exact")


def loss_trace(candidates: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per true neighbour: ``query_id, row_id, true_rank`` and its rank among the candidates by primary, refined and
    corrected score, by the refined score over the length as it is stored in half precision, and by exact score; nulls
    where it was not selected. A missing score ranks last."""
    length = F.when(is_number(F.col("recon_length")) & (F.col("recon_length") > 0), F.col("recon_length"))
    keys = dict(zip(TRACE, (F.col("primary_raw"), F.col("refined_raw"), F.col("corrected"), F.col("refined_raw") / F.coalesce(as_half(length), F.lit(1.0)), F.col("truth_score"))))
    order = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(c.desc_nulls_last(), "row_id"))
    placed = candidates.select("query_id", "row_id", *(order(c).alias(n) for n, c in keys.items()))
    return truth.where(F.col("rank") <= k).select("query_id", "row_id", F.col("rank").alias("true_rank")).join(placed, ["query_id", "row_id"], "left")


def block_check(encoded: DataFrame) -> DataFrame:
    """Per segment: rows, distinct row ids, and whether they are all those from the first to the last."""
    return (
        encoded.groupBy("segment", "row_id").agg(F.count("*").alias("n"))
        .groupBy("segment").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))
        .withColumn("whole", (F.col("rows") == F.col("distinct_rows")) & (F.col("last_row") - F.col("first_row") + 1 == F.col("rows")))
    )


def missed(candidates: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """True neighbours that no candidate is."""
    return truth.where(F.col("rank") <= k).select("query_id", "row_id").join(candidates.select("query_id", "row_id"), ["query_id", "row_id"], "left_anti")


def primary_rank_of_truth(candidates: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """The rank that each true neighbour has by primary score."""
    return truth.where(F.col("rank") <= k).select("query_id", "row_id", F.col("rank").alias("true_rank")).join(ranked(candidates, "primary_raw", "primary_rank").select("query_id", "row_id", "primary_rank"), ["query_id", "row_id"])


def rank_gap(rows: DataFrame, score: str, k: int) -> DataFrame:
    """Per query with more than k rows the score of rank k minus that of rank k + 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "row_id")
    after = ranked(rows, score, "rank", k + 1).withColumn("next", F.lead(score).over(order))
    return after.where((F.col("rank") == k) & F.col("next").isNotNull()).select("query_id", (F.col(score) - F.col("next")).alias("gap"))


def error_summary(rows: DataFrame, estimate: Column, truth: Column, by: list[str]) -> DataFrame:
    """Nearest-rank p50, p90, p99 of the absolute error, its maximum, and rows, per group."""
    e = rows.select(*by, F.abs(estimate - truth).alias("error")).where(is_number(F.col("error")))
    return nearest_rank(["error"], (50, 90, 99), by, e).join(e.groupBy(*by).agg(F.max("error").alias("error_max")), by)


def survivors(rows: DataFrame, k: int) -> DataFrame:
    """Per query: the k-th largest lower bound (the least of all if there are fewer), and how many upper bounds reach it."""
    order = Window.partitionBy("query_id").orderBy(F.desc("lower"), "row_id")
    limit = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).groupBy("query_id").agg(F.min("lower").alias("threshold"))
    return rows.join(limit, "query_id").groupBy("query_id", "threshold").agg(F.count("*").alias("rows"), F.count_if(F.col("upper") >= F.col("threshold")).alias("survivors"))


def enclosure(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Hits whose true score lies outside their interval, their width, and how much of it the estimate uses, in all.

    ``truth`` has the true score of every hit; a hit that it lacks is counted, as a violation.
    """
    j = hits.join(truth.select("query_id", "row_id", F.col("score").alias("true_score")), ["query_id", "row_id"], "left")
    outside = F.coalesce((F.col("true_score") < F.col("lower")) | (F.col("true_score") > F.col("upper")), F.lit(True))
    half = (F.col("upper") - F.col("lower")) / 2
    slack = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.col("true_score") - (F.col("upper") + F.col("lower")) / 2) / half))
    return j.agg(F.count("*").alias("hits"), F.count_if(outside).alias("violations"), F.max(half).alias("widest_half"), F.max(slack).alias("largest_slack"), F.min(slack).alias("least_slack"))


def relevance(found: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query that has relevant rows: the first rank, of at most k, that holds one, its reciprocal (0 if none), and whether there is one."""
    first = found.where(F.col("rank") <= k).join(relevant.select("query_id", "row_id").distinct(), ["query_id", "row_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return relevant.select("query_id").distinct().join(first, "query_id", "left").select("query_id", "first", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal"), F.col("first").isNotNull().cast("long").alias("hit"))


def bootstrap(deltas: np.ndarray, spark: SparkSession, resamples: int = 10_000, seed: int = 0, counts: np.ndarray | None = None) -> DataFrame:
    """Mean and its 2.5 and 97.5 percentiles over resamples of per-query differences.

    With ``counts`` the differences are a histogram: a resample draws how often each value comes, so what is sent to
    the tasks is as large as the number of different values, however many queries there are.
    """
    shared = spark.sparkContext.broadcast((np.asarray(deltas, np.float64), None if counts is None else np.asarray(counts, np.int64)))

    def run(batches):
        x, n = shared.value

        def draw(i: int) -> float:
            rng = np.random.Generator(np.random.PCG64([seed, i]))
            return x[rng.integers(0, len(x), len(x))].mean() if n is None else float((rng.multinomial(n.sum(), n / n.sum()) * x).sum() / n.sum())

        for part in batches:
            yield pd.DataFrame({"id": part["id"], "mean": [draw(i) for i in part["id"].tolist()]})

    means = spark.range(0, resamples, 1, spark.sparkContext.defaultParallelism).mapInPandas(run, "id long, mean double")
    at = lambda p: F.percentile("mean", F.lit(p))
    return means.agg(F.avg("mean").alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"), F.count("*").alias("resamples"))


def recall_gate(hits: int, actual_hits: int, total: int) -> bool:
    """Passes unless recall fell by more than one point; whole hits, no rounding."""
    return hits * 100 <= actual_hits * 100 + total


def spread_trials(requested: int, seeds: int) -> list[int]:
    """Trials per seed, the remainder to the earliest."""
    return [requested // seeds + (i < requested % seeds) for i in range(seeds)]
