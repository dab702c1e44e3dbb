import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.errors import InvalidOptions
from quillon.functions import codec
from quillon.operators import search
from quillon.operators.exact import exact_topk, merge_topk
from quillon.plans.training import train
from quillon.sources.generated import rows
from quillon.spec import ONE, SPEC_64

MODEL = train(rows("correlated", 64, np.arange(600), 1), SPEC_64, 3)


def frame(spark, x, name="row_id", first=0):
    return spark.createDataFrame(pd.DataFrame({name: np.arange(first, first + len(x)), "v": [r.tolist() for r in x]}), f"{name} long, v array<float>")


def reference(x, q, k, budget, metric, own=None):
    """Full sorts over plain sums, sharing no code with the plan under test but the tables."""
    y = MODEL.rotation.forward(codec.directions(x))
    codes, res, p, e = codec.encode(y, MODEL)
    weight = [int(np.float16(np.sqrt((r.astype(float) ** 2).sum())).astype(float) * 2**24) for r in x]
    left, right = codec.query_tables(MODEL.rotation.forward(codec.directions(q[None])), MODEL)
    s1 = [sum(int(left[0][c][r[c]]) for c in range(64)) for r in codes]
    s2 = [s + sum(int(right[0][s_][r[s_]]) for s_ in range(8)) for s, r in zip(s1, res)]
    length = [np.sqrt(sum((a.astype(float) + b.astype(float)) ** 2 for a, b in zip(p[i], e[i]))) for i in range(len(x))]
    scale = weight if metric == "dot" else [1] * len(x)
    pool = sorted((i for i in range(len(x)) if i != own), key=lambda i: (-s1[i] * scale[i], i))[:budget]
    return [(i, s1[i], s2[i]) for i in sorted(pool, key=lambda i: (-s2[i] / length[i] * scale[i], i))[:k]]


@pytest.fixture(scope="module")
def corpus():
    x = rows("correlated", 64, np.arange(700), 4) * np.float32(0.25) * (1 + np.arange(700) % 5).astype(np.float32)[:, None]
    x[300:310] = x[20]  # ties
    return x


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize(("k", "budget"), [(10, 20), (10, 200), (100, 200), (10, 700)])
def test_hits_equal_a_full_sort(spark, corpus, metric, k, budget):
    encoded = search.encode_rows(frame(spark, corpus), MODEL, 128).cache()
    asked = frame(spark, corpus[[5, 20]], "query_id").withColumn("own", F.when(F.col("query_id") == 1, F.lit(20)).cast("long"))
    hits = search.search(encoded.repartition(3), asked, MODEL, k, budget, metric, "own").orderBy("query_id", "rank").collect()
    for i, q in enumerate((5, 20)):
        got = [(h.row_id, h.primary_raw, h.refined_raw) for h in hits if h.query_id == i]
        assert got == reference(corpus, corpus[q], k, budget, metric, 20 if i else None)
        assert all(h.segment == h.row_id // 128 and h.lower <= h.upper for h in hits)
    assert {(h.rows_scanned, h.rows_refined) for h in hits} == {(700, min(budget, 699))}
    assert [h.rank for h in hits if h.query_id == 0] == list(range(1, min(k, budget) + 1))


def test_intervals_hold_the_truth_and_do_not_depend_on_partitions(spark, corpus):
    asked = frame(spark, corpus[:3], "query_id")
    results = []
    for n in (1, 4):
        encoded = search.encode_rows(frame(spark, corpus).repartition(n), MODEL, 256)
        results.append({(h.query_id, h.row_id, h.rank, h.score, h.lower, h.upper) for h in search.search(encoded, asked, MODEL, 20).collect()})
    assert results[0] == results[1]
    truth = {(t.query_id, t.row_id): t.score for t in exact_topk(frame(spark, corpus), asked, 700).collect()}
    assert all(low <= truth[q, r] <= high for q, r, _, _, low, high in results[0])
    dots = {(t.query_id, t.row_id): t.score for t in exact_topk(frame(spark, corpus), asked, 700, "dot").collect()}
    for h in search.search(search.encode_rows(frame(spark, corpus), MODEL, 256), asked, MODEL, 20, metric="dot").collect():
        assert h.lower <= dots[h.query_id, h.row_id] <= h.upper


def test_options_are_checked_in_order(spark):
    with pytest.raises(InvalidOptions, match="k must"):
        search.check_options(0, 5, 10, False)
    with pytest.raises(InvalidOptions, match="budget"):
        search.check_options(10, 5, 10, False)
    assert search.check_options(10, None, 1000, False) == 200
    assert search.check_options(300, None, 1000, False) == 600
    assert search.check_options(50, 50, 10, True) == 9


def test_more_hits_than_rows_and_the_only_row_excluded(spark, corpus):
    few = search.encode_rows(frame(spark, corpus[:3]), MODEL)
    asked = frame(spark, corpus[:1], "query_id").withColumn("own", F.lit(0).cast("long"))
    assert search.search(few, asked, MODEL, 10).count() == 3
    one = search.encode_rows(frame(spark, corpus[:1]), MODEL)
    assert search.search(one, asked, MODEL, 10, exclude="own").count() == 0


def test_a_scan_reads_no_residual_codes(spark, corpus, tmp_path):
    search.encode_rows(frame(spark, corpus[:50]), MODEL).write.parquet(str(tmp_path / "e"))
    plan = search.scan(spark.read.parquet(str(tmp_path / "e")), frame(spark, corpus[:1], "query_id"), MODEL, 10)._jdf.queryExecution().executedPlan().toString()
    assert "mag_bits:int" in plan and "residual:binary" not in plan


def test_exact_search_ties_zero_vectors_and_exclusion(spark):
    x = np.zeros((6, 64), np.float32)
    x[0, 0] = x[1, 0] = x[2, 0] = 1
    x[3, 1], x[4, 0] = 2, 3
    asked = frame(spark, x[[0, 5]], "query_id").withColumn("own", F.lit(1).cast("long"))
    got = [(r.query_id, r.row_id) for r in exact_topk(frame(spark, x), asked, 3, exclude="own").orderBy("query_id", "rank").collect()]
    assert got == [(0, 0), (0, 2), (0, 4)]
    dots = [(r.row_id, r.score) for r in exact_topk(frame(spark, x), asked.where("query_id = 0"), 2, "dot").orderBy("rank").collect()]
    assert dots == [(4, 3.0), (0, 1.0)]
    assert exact_topk(frame(spark, x).limit(0), asked, 3).count() == 0
    assert exact_topk(frame(spark, x), asked.limit(0), 3).count() == 0
    with pytest.raises(InvalidOptions):
        exact_topk(frame(spark, x), asked, 0)


def test_merging_chunks_equals_one_search(spark, corpus):
    asked = frame(spark, corpus[:4], "query_id")
    whole = {tuple(r) for r in exact_topk(frame(spark, corpus), asked, 10).select("query_id", "row_id", "score", "rank").collect()}
    state = None
    for a, b in ((400, 700), (0, 1), (1, 400)):
        new = exact_topk(frame(spark, corpus[a:b], first=a), asked, 10)
        state = new if state is None else merge_topk(state, new, 10)
    assert {tuple(r) for r in state.select("query_id", "row_id", "score", "rank").collect()} == whole


def test_unit_lengths_rank_alike_by_cosine_and_dot(spark):
    x = codec.directions(rows("gaussian", 64, np.arange(300), 8))
    encoded, asked = search.encode_rows(frame(spark, x), MODEL), frame(spark, x[:2], "query_id")
    a, b = ([(r.query_id, r.row_id) for r in search.search(encoded, asked, MODEL, 10, metric=m).orderBy("query_id", "rank").collect()] for m in ("cosine", "dot"))
    assert a == b
    assert ONE == 1 << 24
