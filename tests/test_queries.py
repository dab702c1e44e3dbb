import os
import subprocess
import sys

import numpy as np
import pytest
from helpers import DATA, duckdb_rows, spark_rows

from quillon import qualify
from quillon import queries as core
from quillon.operators import evaluate

SF = "sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/{SF}"), reason="no test data")
SQL = core.oracle_sql() | qualify.oracle_sql()
QUERIES = core.queries() | qualify.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    columns, got = spark_rows(QUERIES[name](spark, f"{DATA}/{SF}"))
    assert got == duckdb_rows(SQL[name], SF, columns)


def test_intervals_enclose_and_recall_is_high(spark):
    d = f"{DATA}/{SF}"
    assert core.interval_enclosure(spark, d).first()["violations"] == 0
    assert {r.violations for r in core.certificate_soak(spark, d, 4000).collect()} == {0}
    r = core.trained_recall(spark, d).groupBy().avg("recall").first()[0]
    assert r >= 0.85
    assert all(r.recall >= r.compressed_recall for r in core.original_rerank(spark, d).collect())
    for r in core.epsilon_attribution(spark, d).collect():
        assert abs(r.transform + r.reconstruction + r.serving - 1) < 1e-6


def test_intervals_of_all_hits_are_checked_whatever_their_exact_rank(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    x[::2] = x[0] + 1e-4 * rng.standard_normal((1000, 64))  # with the 500 below, more than 1,000 alike
    x[1::4] = x[0] + 1e-4 * rng.standard_normal((500, 64))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    said = core.interval_enclosure(spark, str(tmp_path)).first()
    assert said["hits"] == 40 * 10 and said["violations"] == 0
    hits = spark.createDataFrame([(0, 1, 0.4, 0.6), (0, 2, 0.4, 0.6), (0, 3, 0.4, 0.6)], "query_id long, row_id long, lower double, upper double")
    truth = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.3)], "query_id long, row_id long, score double")
    said = evaluate.enclosure(hits, truth).first()
    assert (said["hits"], said["violations"]) == (3, 2)


def test_generations_are_searchable_one_by_one(spark):
    got = core.append_generations(spark, f"{DATA}/{SF}").collect()
    assert {h.generation for h in got} == {1, 2} and len(got) == 2 * 10 * 10


def test_centers_and_generations_of_more_rows_than_training_takes(spark, tmp_path, monkeypatch):
    from quillon.functions import codec
    from quillon.plans import training

    monkeypatch.setattr(training, "MAX_TRAINING", 500)
    monkeypatch.setattr(core, "MAX_TRAINING", 500, raising=False)
    x = np.random.default_rng(6).standard_normal((1001, 64)).astype(np.float32)
    x[:400, 3], x[5:9, 4], x[:, 5] = -0.0, 0.0, 1.5  # equal values
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.coord, r.code): r.center for r in core.quantile_centers(spark, str(tmp_path)).collect()}
    assert got == {(c, k): float(v) for c, row in enumerate(codec.quantile_centers(x, 16)) for k, v in enumerate(row)}
    assert len(core.append_generations(spark, str(tmp_path)).collect()) == 2 * 21 * 10


def test_the_rest_does_not_need_the_training_data_package():
    code = "import sys; sys.modules['quillon.llm'] = None; import __spark_entry__ as e; assert 'search_cosine' in e.queries() and not [q for q in e.queries() if q[0] == 'p' and q[1].isdigit()]; e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
