"""Mixing sources to target shares of the tokens (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.select import key_of_fraction, smallest_per_group


def allocate(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per plan and source: ``available`` tokens, ``target_tokens``, and ``wanted``, what repetition can reach of them.

    The mix is as large as all documents together, those without source included, or ``total`` tokens. Targets
    of null plan, source, share or repeats are left out, those repeated count once; a source without documents
    has 0 available.
    """
    by_source = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    whole = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("total")) if total is None else sized.sparkSession.createDataFrame([(float(total),)], "total double")
    return (
        targets.dropna(subset=["plan_name", "source", "target_share", "max_repeats"])
        .select("plan_name", "source", "target_share", "max_repeats")
        .distinct()
        .join(by_source, "source", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .join(whole)  # one row
        .withColumn("target_tokens", F.col("target_share") * F.col("total"))
        .withColumn("wanted", F.least(F.col("target_tokens"), F.col("max_repeats") * F.col("available")))
    )


def expected_copies(offered: DataFrame) -> DataFrame:
    """Adds ``expected``, the copies of each document that a plan can expect: min(max_repeats, x * weight), with x
    such that the tokens of a plan and source add up to ``wanted``.

    ``offered`` has ``plan_name, source, tokens, weight, wanted, max_repeats``. The documents are ranked by weight:
    x is right if just those at max_repeats are the ones of the largest weights. It is sought among the distinct
    weights of a source, of which there are as many as sizes, not as documents.
    """
    by = ["plan_name", "source"]
    levels = offered.groupBy(*by, "weight").agg(F.sum("tokens").cast("double").alias("t"), F.first("wanted").alias("wanted"), F.first("max_repeats").cast("double").alias("most"))
    heavier = Window.partitionBy(*by).orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(*by).orderBy(F.desc("weight")).rowsBetween(0, Window.unboundedFollowing)
    # x if all heavier documents stand at the most and those of this weight do not
    tried = levels.withColumn("x", (F.col("wanted") - F.col("most") * F.coalesce(F.sum("t").over(heavier), F.lit(0.0))) / F.sum(F.col("t") * F.col("weight")).over(rest))
    fitting = F.col("x") * F.col("weight") <= F.col("most") * (1 + 1e-12)
    factor = tried.groupBy(*by).agg(F.max_by("x", F.when(fitting, F.col("weight"))).alias("x"))
    return offered.join(factor, by, "left").withColumn("expected", F.coalesce(F.least(F.col("max_repeats").cast("double"), F.greatest("x", F.lit(0.0)) * F.col("weight")), F.col("max_repeats").cast("double"))).drop("x")


def mix(sized: DataFrame, allocation: DataFrame, seed: int = 0, power: float = 0.0) -> DataFrame:
    """The documents of each plan: ``plan_name, source, doc_id, tokens, copies``.

    The copies that a document can expect are proportional to tokens ** ``power``, never more than
    ``max_repeats``, and make up the ``wanted`` tokens of its plan and source (``expected_copies``). At power 0 all
    documents of a source have one chance, at 1 a token's chance grows with its document. As many whole copies as
    a document can expect are certain. The rest is drawn by Pareto order sampling: each document gets the rank
    [u / (1 - u)] / [p / (1 - p)] from a number u that is a hash of its id, the plan and the seed, and its
    remaining chance p; those of smallest rank are taken until their tokens make up what is missing. The rank
    does not depend on partitions or runs. The sum ends within half a document of what is wanted, a document
    never exceeds ``max_repeats`` copies, since the rest is drawn only below that.

    Documents without source, id or tokens are in no mix. The cut in rank order is found by
    ``smallest_per_group``, so a source that holds most documents is not sorted in one task.
    """
    docs = sized.where((F.col("tokens") > 0) & F.col("source").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "source", "tokens")
    plans = allocation.where((F.col("available") > 0) & (F.col("wanted") > 0)).select("plan_name", "source", "wanted", "max_repeats")
    offered = (
        expected_copies(docs.join(plans, "source").withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(float(power)))))
        .withColumn("whole", F.floor(F.round("expected", 9)))
        .withColumn("chance", F.greatest(F.lit(0.0), F.col("expected") - F.col("whole")))
    )
    certain = offered.groupBy("plan_name", "source").agg((F.first("wanted") - F.sum(F.col("whole") * F.col("tokens"))).alias("rest"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "plan_name", "doc_id"), 12) + 0.5) / float(1 << 52)
    odds = F.try_divide(u / (1 - u) * (1 - F.col("chance")), F.col("chance"))
    ranked = offered.where(F.col("chance") > 1e-9).withColumn("key", key_of_fraction(odds / (1 + odds))).join(certain.where("rest > 0"), ["plan_name", "source"])
    drawn = smallest_per_group(ranked, ["plan_name", "source"], "key", "rest", ["doc_id"], weight="tokens")
    columns = ("plan_name", "source", "doc_id", "tokens")
    return (
        offered.where(F.col("whole") > 0)
        .select(*columns, F.col("whole").alias("copies"))
        .unionByName(drawn.select(*columns, F.lit(1).cast("long").alias("copies")))
        .groupBy(*columns)
        .agg(F.sum("copies").alias("copies"))
    )


def shares(sized: DataFrame, targets: DataFrame, seed: int = 0, power: float = 0.0) -> DataFrame:
    """Per plan and source: target and reached share of the tokens, documents and copies used, and ``short``.

    ``reached_share`` is of the tokens of the whole mix that was asked for, ``actual_share`` of those in the mix,
    which is smaller where sources fall short. ``short`` says that all documents
    at ``max_repeats`` copies do not make up the target.
    """
    allocation = allocate(sized, targets)
    used = mix(sized, allocation, seed, power).groupBy("plan_name", "source").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("tokens")).alias("reached_tokens")
    )
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "most_copies", "reached_tokens")]
    return (
        allocation.join(used, ["plan_name", "source"], "left")
        .select("plan_name", "source", "target_share", "max_repeats", "total", "available", "target_tokens", *none)
        .withColumn("reached_share", F.try_divide(F.col("reached_tokens"), F.col("total")))
        .withColumn("actual_share", F.try_divide(F.col("reached_tokens"), F.sum("reached_tokens").over(Window.partitionBy("plan_name"))))
        .withColumn("short", F.col("max_repeats") * F.col("available") < F.col("target_tokens"))
    )
