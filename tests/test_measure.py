import json

import numpy as np
import pandas as pd

from quillon.plans import measure
from quillon.plans.index import Index, IndexBuilder
from quillon.sources.generated import factors, rows, splitmix
from quillon.spec import SPEC_64


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(x)), "v": [r.tolist() for r in x]}), "row_id long, v array<float>")


def test_probe_latency_and_fingerprints(spark, tmp_path):
    x = rows("correlated", 64, np.arange(420), 4)
    builder = IndexBuilder.create(spark, str(tmp_path / "ix"), frame(spark, x[:400]), 1, spec=SPEC_64)
    builder.push(frame(spark, x), "row_id")
    builder.commit()
    index = Index.open(spark, str(tmp_path / "ix"))
    ask = lambda n, metric="cosine": json.dumps({"metric": metric, "queries": x[:n].tolist()})
    lines = [json.loads(a) for a in measure.probe(index, [ask(2), ask(2), ask(9), ask(1, "other"), "{", ask(2, "dot")], 3)]
    assert lines[0]["fingerprint"] == lines[1]["fingerprint"] != lines[5]["fingerprint"] and lines[0]["hits"] == 6
    assert all("error" in lines[i] for i in (2, 3, 4))
    q = spark.createDataFrame([(0, x[0].tolist())], "query_id long, v array<float>")
    hits = index.search(q, 5)
    assert measure.distributed_fingerprint(hits).first() == measure.distributed_fingerprint(hits.repartition(3)).first()
    assert measure.measure_latency(index, x[:2].tolist(), 3)["rows"] == 420


def test_gates_ranks_and_provenance():
    assert measure.percentiles([3.0, 1.0, 2.0, 4.0]) == {"p50": 2.0, "p90": 4.0, "p99": 4.0, "max": 4.0}
    assert measure.latency_gate(1_000_000, 1000, 50, True, True, 150.0, 300.0) == {"eligible": True, "passed": True}
    assert measure.latency_gate(1_000_000, 1000, 50, True, True, 150.1, 300.0)["passed"] is False
    assert measure.latency_gate(5, 1000, 50, True, True, 1.0, 1.0) == {"eligible": False, "passed": None}
    assert measure.throughput(10, 0.0) is None and measure.throughput(10, 2.0) == 5
    assert {"system", "commit", "dirty", "time"} <= measure.provenance().keys()
    assert measure.build_memory_bound(32_768, 768) < 1 << 30


def test_small_generators():
    a = splitmix(7, 1000)
    assert (a == splitmix(7, 1000)).all() and (a >= -1).all() and (a < 1).all() and abs(a.mean()) < 0.1
    m = np.random.default_rng(1).random((20, 12))
    u, v = factors(m, 12, 16)
    assert u.shape == (20, 16) and np.abs(u @ v.T - m).max() < 1e-5
    assert (factors(m, 4, 16)[0] == factors(m, 4, 16)[0]).all()


def test_callers_builds_and_memory(spark, tmp_path):
    from quillon.plans.index import Index, IndexBuilder
    from quillon.queries import frozen_model
    from quillon.sources.generated import rows

    x = rows("gaussian", 64, np.arange(60), 1).tolist()
    frame = spark.createDataFrame(list(enumerate(x)), "row_id long, v array<float>")
    for name, n in (("a", 1), ("b", 3)):
        builder = IndexBuilder.create(spark, str(tmp_path / name), None, spec=frozen_model().spec, model=frozen_model())
        builder.push(frame.repartition(n), "row_id")
        builder.commit()
    a, b = (Index.open(spark, str(tmp_path / n)) for n in "ab")
    said = measure.compare_builds(a, b, frame.limit(5).withColumnRenamed("row_id", "query_id"), rounds=2)
    assert said["same"] and said["ratio"] > 0
    callers = measure.measure_callers(a, x[:4], (1, 2))
    assert [c["callers"] for c in callers] == [1, 2] and all(c["queries_per_second"] > 0 and c["ms"]["p50"] <= c["ms"]["max"] for c in callers)
    assert all(v > 0 for v in measure.memory(spark).values())
