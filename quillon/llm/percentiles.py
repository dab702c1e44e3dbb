"""Percentiles with bounded rank error whose daily results can be merged (problem 5).

The sketch is KLL, a hierarchy of randomized compactors: a full level is sorted and every other value, from a
random offset, moves up a level with twice the weight; two sketches merge level by level. Spark's own
aggregate is used, so that it runs in the JVM with partial aggregation before the shuffle: of a group of any
size each task sends one sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.drift import nearest_rank

#: Size parameter of the sketches.
K = 4096
PERCENTS = (50, 90, 99)
KINDS = ("primary", "refined")
GROUP = ("run_id", "candidate_budget")


def rank_error(k: int = K) -> float:
    """The rank error, as a share of n, that a KLL sketch of size k keeps with 99 percent confidence.

    The published fit of the sketch's error to its size for single ranks.
    """
    return 2.296 / k**0.9021


def measured(bound_widths: DataFrame) -> DataFrame:
    """Each sample once: ``run_id, candidate_budget, day, primary, refined``.

    Of a sample sent several times the row that arrived first counts (null arrivals first, then the smaller
    values). Null, NaN, infinite and negative widths become null, that is unmeasured; rows of null sample_id
    cannot be told apart and are left out; null run, budget or day are groups of their own.
    """
    width = lambda c: F.when((F.col(c) >= 0) & (F.col(c) < F.lit(float("inf"))), F.col(c))
    once = (
        bound_widths.where(F.col("sample_id").isNotNull())
        .select("sample_id", F.struct("arrived_at", *GROUP, F.to_date("measured_at").alias("day"), *(width(f"{k}_bound_width").alias(k) for k in KINDS)).alias("s"))
        .groupBy("sample_id")
        .agg(F.min("s").alias("s"))
    )
    return once.select(*(f"s.{c}" for c in (*GROUP, "day", *KINDS)))


def daily_sketches(widths: DataFrame, k: int = K) -> DataFrame:
    """One sketch per run, budget, day and kind (columns ``primary``, ``refined``), to be stored and merged later."""
    return widths.groupBy(*GROUP, "day").agg(*(F.kll_sketch_agg_double(c, F.lit(k)).alias(c) for c in KINDS))


def merge_sketches(sketches: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Sketches of any days merged per group."""
    return sketches.groupBy(*by).agg(*(F.kll_merge_agg_double(c).alias(c) for c in KINDS))


def _quantile(sketch: Column, rank: float) -> Column:
    n = F.kll_sketch_get_n_double(sketch)
    return F.when(n > 0, F.kll_sketch_get_quantile_double(F.when(n > 0, sketch), F.lit(min(1.0, max(0.0, rank)))))


def summaries(sketches: DataFrame, k: int = K) -> DataFrame:
    """``run_id, candidate_budget, width_kind, statistic, n, value, low, high`` for p50, p90 and p99.

    The exact value lies in [low, high]: those are the answers at twice the rank error of 99 percent
    confidence to either side. A group without measured widths gives no rows.
    """
    e, parts = 2 * rank_error(k), []
    for kind in KINDS:
        for p in PERCENTS:
            at = lambda r, c=kind: _quantile(F.col(c), r)
            parts.append(F.struct(F.lit(kind).alias("width_kind"), F.lit(f"p{p}").alias("statistic"), F.lit(p).alias("percent"), F.kll_sketch_get_n_double(kind).alias("n"), at(p / 100).alias("value"), at(p / 100 - e).alias("low"), at(p / 100 + e).alias("high")))
    return sketches.select(*GROUP, F.explode(F.array(*parts)).alias("s")).select(*GROUP, "s.*").where(F.col("n") > 0)


def published(budget_outcomes: DataFrame) -> DataFrame:
    """The published percentiles, one per row: ``run_id, candidate_budget, width_kind, statistic, published``; nulls left out."""
    parts = [F.struct(F.lit(kind).alias("width_kind"), F.lit(f"p{p}").alias("statistic"), F.col(f"{kind}_bound_width_percentiles.p{p}").alias("published")) for kind in KINDS for p in PERCENTS]
    return budget_outcomes.select(*GROUP, F.explode(F.array(*parts)).alias("s")).select(*GROUP, "s.*").where(F.col("published").isNotNull())


def deviations(bound_widths: DataFrame, budget_outcomes: DataFrame, tolerance: float = 0.05, k: int = K) -> DataFrame:
    """Published percentiles that are off by more than ``tolerance`` of the exact one.

    The sketch's interval decides where all values in it agree. For the rest the exact value is selected from
    the widths inside the interval, whose ranks start after the count of smaller widths: an exact check over a
    narrow band of a few groups. Null struct or statistic and groups without measured widths are no case.
    """
    widths = measured(bound_widths)
    off = lambda v: F.abs(F.col("published") - v) > F.lit(tolerance) * F.abs(v)
    compared = published(budget_outcomes).join(summaries(merge_sketches(daily_sketches(widths, k)), k), [*GROUP, "width_kind", "statistic"])
    # off() holds outside an interval around the published value, so both ends and the same side decide all between
    compared = compared.withColumn(
        "sure",
        F.when(~off(F.col("low")) & ~off(F.col("high")), F.lit(False)).when(
            off(F.col("low")) & off(F.col("high")) & ((F.col("published") < F.col("low")) | (F.col("published") > F.col("high"))), F.lit(True)
        ),
    )
    key = [*GROUP, "width_kind", "statistic"]
    found = compared.where(F.col("sure")).select(*key)
    open_ = compared.where(F.col("sure").isNull()).select(*key, "published", "percent", "n", "low", "high")
    # one row a group, so that widths meet it once, and only those of open groups are taken apart
    by_group = open_.groupBy(*GROUP).agg(F.collect_list(F.struct("width_kind", "statistic", "published", "percent", "n", "low", "high")).alias("o"))
    width = F.when(F.col("width_kind") == KINDS[0], F.col(KINDS[0])).otherwise(F.col(KINDS[1]))
    near = widths.join(by_group, list(GROUP)).select(*GROUP, *KINDS, F.inline("o")).withColumn("width", width).where(F.col("width") <= F.col("high"))
    values = near.groupBy(*key, "published", "percent", "n", F.greatest("width", "low").alias("at"), (F.col("width") < F.col("low")).alias("under")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*key).orderBy(F.desc("under"), "at"))
    exact = (
        values.withColumn("upto", upto)
        .where(~F.col("under") & (F.col("upto") >= F.expr("(percent * n + 99) div 100")))
        .groupBy(*key, "published")
        .agg(F.min("at").alias("exact"))
    )
    return found.unionByName(exact.where(off(F.col("exact"))).select(*key)).distinct()


def enclosure(bound_widths: DataFrame, k: int = K) -> DataFrame:
    """Per group, kind and statistic: ``n`` and whether the exact value lies in the interval of the merged sketches."""
    widths = measured(bound_widths)
    exact = None
    for kind in KINDS:
        ranks = nearest_rank([kind], PERCENTS, list(GROUP), widths)
        part = ranks.select(*GROUP, F.explode(F.array(*(F.struct(F.lit(kind).alias("width_kind"), F.lit(f"p{p}").alias("statistic"), F.col(f"{kind}_p{p}").alias("exact")) for p in PERCENTS))).alias("s")).select(*GROUP, "s.*")
        exact = part if exact is None else exact.unionByName(part)
    said = summaries(merge_sketches(daily_sketches(widths, k)), k)
    same = [exact[c].eqNullSafe(said[c]) for c in (*GROUP, "width_kind", "statistic")]
    return exact.join(said, on=same).select(*(exact[c] for c in (*GROUP, "width_kind", "statistic")), "n", F.col("exact").between(F.col("low"), F.col("high")).alias("inside"))
