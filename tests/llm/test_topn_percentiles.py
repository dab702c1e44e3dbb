import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillon.llm import percentiles as P
from quillon.llm.topn import best_lists, top_n


def test_best_rows_with_ties_repeats_and_unusable_scores(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, r, float(r % 4), "x") for r in range(40)] * 2 + [(1, 3, 9.0, "x"), (1, 99, nan, "x"), (1, 98, inf, "x"), (1, 97, -inf, "x"), (1, 96, None, "x"), (2, 1, -0.0, "x"), (2, 0, 0.0, "x"), (None, 1, 5.0, "x"), (3, None, 5.0, "x"), (4, 1, nan, "x")]
    df = spark.createDataFrame(data, "query_id long, row_id long, s double, rank string")
    got = [(r.query_id, r.row_id, r.s, r["rank"]) for r in top_n(df.repartition(3), "query_id", "s", "row_id", 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 3, 9.0, 1), (1, 7, 3.0, 2), (1, 11, 3.0, 3), (1, 15, 3.0, 4), (1, 19, 3.0, 5), (2, 0, 0.0, 1), (2, 1, 0.0, 2)]
    assert top_n(df.limit(0), "query_id", "s", "row_id", 5).count() == 0


def test_a_group_of_most_rows_equals_a_plain_sort_and_is_limited_before_the_shuffle(spark):
    random.seed(1)
    data = [(0 if random.random() < 0.7 else random.randrange(50), random.randrange(3000), round(random.random(), 3)) for _ in range(8000)]
    df = spark.createDataFrame(data, "query_id long, row_id long, corrected double").repartition(6)
    best = {}
    for q, r, s in data:
        best[q, r] = max(s, best.get((q, r), -1.0))
    want = {(q, r) for g in {k[0] for k in best} for (q, r), _ in sorted(((k, s) for k, s in best.items() if k[0] == g), key=lambda x: (-x[1], x[0][1]))[:10]}
    found = best_lists(df, df.withColumnRenamed("corrected", "score").limit(0)).cache()
    assert {(r.query_id, r.row_id) for r in found.collect()} == want
    plan = top_n(df, "query_id", "corrected", "row_id", 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


START = datetime(2026, 1, 1)
WIDTHS = "sample_id long, run_id string, candidate_budget int, query_no int, primary_bound_width double, refined_bound_width double, measured_at timestamp, arrived_at timestamp, day string"


def widths(spark, n=9000):
    random.seed(2)
    data = []
    for i in range(n):
        run = "hot" if i % 3 else f"r{i % 5}"
        v = random.lognormvariate(-2, 0.5)
        p = (v, None, float("nan"), -1.0, float("inf"))[random.choice([0] * 40 + [1, 2, 3, 4])]
        row = (i, run, 200, i, p, v / 3, START + timedelta(hours=i % 90), START + timedelta(hours=i % 90), "x")
        data += [row] * (1 + (i % 11 == 0))
    data += [(5, "hot", 200, 5, 99.0, 99.0, START, START + timedelta(days=400), "x"), (None, "hot", 200, 1, 9.0, 9.0, START, START, "x")]
    return spark.createDataFrame(data, WIDTHS), data


def exact(data, run, column, p):
    once = {}
    for r in sorted((r for r in data if r[0] is not None), key=lambda r: r[7]):
        once.setdefault(r[0], r)
    v = sorted(r[column] for r in once.values() if r[1] == run and r[column] is not None and 0 <= r[column] < math.inf)
    return v, v[(p * len(v) + 99) // 100 - 1]


def test_sketches_of_days_merge_and_keep_their_bounds(spark):
    df, data = widths(spark)
    k = 256
    daily = P.daily_sketches(P.measured(df), k)
    assert daily.select("day").distinct().count() == 4
    got = {(r.run_id, r.width_kind, r.statistic): r for r in P.summaries(P.merge_sketches(daily), k).collect()}
    assert len(got) == 6 * 6
    for (run, kind, stat), r in got.items():
        v, x = exact(data, run, 4 if kind == "primary" else 5, int(stat[1:]))
        assert r.n == len(v) and r.low <= x <= r.high
        if len(v) < k:
            assert r["value"] == x


def test_deviations_are_decided_exactly(spark):
    df, data = widths(spark)
    struct = "struct<p50 double, p90 double, p99 double, widest double>"
    outcomes, want = [], set()
    for run, factor in (("hot", 1.0), ("r0", 1.0501), ("r3", 0.951), ("r1", 1.2)):
        both = []
        for kind, column in (("primary", 4), ("refined", 5)):
            values = []
            for p in (50, 90, 99):
                x = exact(data, run, column, p)[1]
                f = 1.0499 if (run, p) == ("hot", 90) else 1.0502 if (run, p) == ("hot", 50) else factor
                values.append(x * f)
                if abs(x * f - x) > 0.05 * x:
                    want.add((run, 200, kind, f"p{p}"))
            both.append((*values, 1.0))
        outcomes.append((run, 200, *both))
    outcomes += [("r2", 200, None, (None, None, 9.0, 1.0)), ("absent", 200, (1.0, 1.0, 1.0, 1.0), None)]
    want.add(("r2", 200, "refined", "p99"))
    said = spark.createDataFrame(outcomes, f"run_id string, candidate_budget int, primary_bound_width_percentiles {struct.replace(' double', ': double')}, refined_bound_width_percentiles {struct.replace(' double', ': double')}")
    for k in (64, P.K):
        assert {tuple(r) for r in P.deviations(df, said, k=k).collect()} == want
    assert P.deviations(df.limit(0), said).count() == 0
    assert P.deviations(df, said.limit(0)).count() == 0
    assert P.measured(df).where(F.col("primary").isNull()).count() > 0
