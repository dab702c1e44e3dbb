import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon import sqlapi
from quillon.errors import Corrupt
from quillon.functions import text
from quillon.operators import audit, evaluate
from quillon.plans.index import Index, IndexBuilder
from quillon.plans.training import train
from quillon.sources import files
from quillon.sources.generated import generated, rows
from quillon.spec import SPEC_64
from quillon.streaming.ingest import StreamingTopK, append_batch


def frame(spark, x, first=0, name="row_id"):
    return spark.createDataFrame(pd.DataFrame({name: np.arange(first, first + len(x)), "v": [r.tolist() for r in x]}), f"{name} long, v array<float>")


def test_raw_files_descriptors_and_hashes(spark, tmp_path):
    x = rows("gaussian", 16, np.arange(50), 1)
    path = tmp_path / "v.f32"
    x.astype("<f4").tofile(path)
    got = files.raw_vectors(spark, str(path), 16).orderBy("row_id").toPandas()
    assert (np.vstack(got.v) == x).all() and got.row_id.tolist() == list(range(50))
    a = files.corpus_hash(frame(spark, x))
    assert a == files.corpus_hash(frame(spark, x).repartition(7)) != files.corpus_hash(frame(spark, x, 1))
    d = {"path": str(path), "dimension": 16, "row_count": 50, "sha256": hashlib.sha256(path.read_bytes()).hexdigest()}
    (tmp_path / "d.json").write_text(json.dumps(d))
    assert files.descriptor(str(tmp_path / "d.json")) == d
    path.write_bytes(path.read_bytes()[:-4])
    with pytest.raises(Corrupt):
        files.descriptor(str(tmp_path / "d.json"))


def test_generated_corpora_grow_without_changing(spark):
    small = {r.row_id: tuple(r.v) for r in generated(spark, "generated-correlated-8x10", 5).collect()}
    large = {r.row_id: tuple(r.v) for r in generated(spark, "generated-correlated-8x30", 5).repartition(3).collect()}
    assert len(large) == 30 and all(large[k] == v for k, v in small.items())


def test_stored_lists_are_refused_unless_whole_and_ranked(spark, tmp_path):
    good = [(0, 1, 3, 0.5), (0, 2, 1, 0.25), (1, 1, 0, 1.0), (1, 2, 2, 1.0)]
    frame = lambda rows: spark.createDataFrame(rows, "query_id long, rank int, row_id long, score double")
    files.write_lists(frame(good), str(tmp_path / "good"), 4, 2)
    lists, rows, k = files.read_lists(spark, str(tmp_path / "good"))
    assert (sorted(tuple(r) for r in lists.collect()), rows, k) == (good, 4, 2)
    bad = {
        "cut": good[:3], "twice": [*good[:3], (1, 2, 0, 1.0)], "order": [(0, 1, 3, 0.25), (0, 2, 1, 0.5), *good[2:]], "tie": [*good[:2], (1, 1, 2, 1.0), (1, 2, 0, 1.0)],
        "row": [*good[:3], (1, 2, 4, 1.0)], "rank": [*good[:3], (1, 3, 2, 1.0)], "nan": [*good[:3], (1, 2, 2, float("nan"))],
    }
    for name, rows in bad.items():
        files.write_lists(frame(rows), str(tmp_path / name), 4, 2)
        with pytest.raises(Corrupt):
            files.read_lists(spark, str(tmp_path / name))
    files.write_lists(frame([]), str(tmp_path / "none"), 0, 2)
    assert files.read_lists(spark, str(tmp_path / "none"))[0].count() == 0
    frame(good[:2]).write.mode("overwrite").parquet(str(tmp_path / "good" / "lists"))
    with pytest.raises(Corrupt):
        files.read_lists(spark, str(tmp_path / "good"))


def test_reports_keep_to_their_schema(tmp_path):
    schema = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 1}, "x": {"type": ["number", "null"]}, "l": {"type": "array", "items": {"enum": ["a"]}, "maxItems": 2}}}
    files.write_report(str(tmp_path / "r.json"), {"n": 2, "x": None, "l": ["a"]}, schema)
    for bad in ({}, {"n": 0}, {"n": 1.5}, {"n": True}, {"n": 1, "y": 0}, {"n": 1, "l": ["b"]}, {"n": 1, "l": ["a"] * 3}):
        with pytest.raises(ValueError):
            files.write_report(str(tmp_path / "bad.json"), bad, schema)
    assert not (tmp_path / "bad.json").exists()


def test_texts(spark):
    df = spark.createDataFrame([(1, " A  b\n"), (2, "a B"), (3, None), (4, "c"), (5, "")], "id long, t string")
    got = {r.id for r in text.distinct_texts(df, "t", "id").collect()}
    assert got - {1, 2} == {4, 5} and len(got & {1, 2}) == 1
    assert text.shared_texts(df.where("id = 1"), df.where("id > 1"), "t").count() == 1
    assert text.shared_texts(df.where("id = 4"), df.where("id = 5"), "t").count() == 0
    names = spark.createDataFrame([("T", "b"), ("", "b"), (None, " b ")], "x string, y string")
    assert [r.z for r in names.select(text.assemble(F.col("x"), F.col("y")).alias("z")).collect()] == ["T\nb", "b", "b"]
    sample = {r.id for r in text.hash_sample(spark.range(500), "id", 50).collect()}
    grown = {r.id for r in text.hash_sample(spark.range(501).repartition(5), "id", 50).collect()}
    assert len(sample) == len(grown) == 50 and len(sample & grown) >= 49
    segments = spark.createDataFrame([(0, 0, 5), (1, 5, 5), (2, 11, 1)], "segment int, first_row long, row_count long")
    assert [r.segment for r in text.gaps(segments).collect()] == [2]


def test_audit_counts_each_kind_of_length(spark):
    e = lambda x: [float(x)] + [0.0] * 7
    data = [("a", i, v) for i, v in enumerate([e(1)] * 90 + [e(14)] * 10)] + [("b", 100, e(float("nan"))), ("b", 101, None), ("b", 102, [1.0]), ("b", 103, e(1e-20)), ("b", 104, e(70_000)), ("b", 105, e(1e-9))]
    df = spark.createDataFrame(data, "g string, id long, v array<float>")
    a = {r.g: r for r in audit.audit(df, ["g"], 8).collect()}
    assert (a["a"].accepted, a["a"].near_unit, a["a"].length_p50, a["a"].length_p95, a["a"].length_max) == (100, 90, 1.0, 14.0, 14.0)
    b = a["b"]
    assert (b.vectors, b.finite, b.non_finite, b.accepted, b.above, b.below, b.underflow, b.near_zero) == (6, 3, 3, 1, 1, 1, 1, 2)
    bad = [(r.id, r.why) for r in audit.first_invalid(df, "id", ["g"], 8, 3).orderBy("place").collect()]
    assert bad == [(100, "non_finite"), (101, "null"), (102, "dimension")]


def test_recall_relevance_bootstrap_and_survivors(spark):
    truth = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "query_id long, row_id long, rank int")
    found = spark.createDataFrame([(1, 11, 1), (1, 99, 2), (3, 20, 1)], "query_id long, row_id long, rank int")
    assert {(r.query_id, r.hits, r.wanted) for r in evaluate.recall(found, truth, 2).collect()} == {(1, 1, 2), (2, 0, 1)}
    assert {(r.query_id, r.first, r.reciprocal, r.hit) for r in evaluate.relevance(found, truth, 10).collect()} == {(1, 1, 1.0, 1), (2, None, 0.0, 0)}
    b = evaluate.bootstrap(np.array([0.0, 1.0] * 50), spark, 400).first()
    assert abs(b["mean"] - 0.5) < 0.02 and 0.3 < b["low"] < 0.5 < b["high"] < 0.7
    assert b == evaluate.bootstrap(np.array([0.0, 1.0] * 50), spark, 400).first()
    bounds = spark.createDataFrame([(1, i, i / 10, i / 10 + 0.15) for i in range(10)], "query_id long, row_id long, lower double, upper double")
    s = evaluate.survivors(bounds, 3).first()
    assert (s["threshold"], s["rows"], s["survivors"]) == (0.7, 10, 4)
    assert evaluate.spread_trials(10, 4) == [3, 3, 2, 2]
    assert evaluate.recall_gate(90, 90, 100) and evaluate.recall_gate(91, 90, 100) and not evaluate.recall_gate(92, 90, 100)


def test_batches_may_come_again(spark, tmp_path):
    x = rows("correlated", 64, np.arange(460), 4)
    path = str(tmp_path / "ix")
    builder = IndexBuilder.create(spark, path, frame(spark, x[:400]), 1, spec=SPEC_64)
    builder.push(frame(spark, x[:10]), "row_id")
    builder.commit()
    feed = append_batch(spark, path, "row_id")
    for epoch, (a, b) in ((0, (400, 430)), (0, (400, 430)), (1, (430, 430)), (2, (430, 460)), (2, (430, 460))):
        feed(frame(spark, x[a:b], a), epoch)
    index = Index.open(spark, path)
    assert (len(index), index.generation, index.manifest["epoch"]) == (70, 3, 2)


def test_a_stream_keeps_the_exact_best(spark, tmp_path):
    x = rows("gaussian", 64, np.arange(90), 6)
    for i in range(3):
        frame(spark, x[30 * i : 30 * i + 30], 30 * i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    asked = frame(spark, x[:2], name="query_id")
    best = StreamingTopK(spark, asked, 5, str(tmp_path / "state"))
    stream = spark.readStream.schema("row_id long, v array<float>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = best.start(stream, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    from quillon.operators.exact import exact_topk

    want = {tuple(r) for r in exact_topk(frame(spark, x), asked, 5).select("query_id", "row_id", "rank").collect()}
    assert {tuple(r) for r in best.at(50).select("query_id", "row_id", "rank").collect()} == want
    best.update(frame(spark, x[60:], 60), 3)  # rows seen before change nothing
    assert {tuple(r) for r in best.at(3).select("query_id", "row_id", "rank").collect()} == want


def test_functions_in_sql(spark, tmp_path):
    x = rows("correlated", 64, np.arange(450), 4)
    model = train(x[:400], SPEC_64, 3)
    sqlapi.register(spark, model)
    frame(spark, x[:20]).unionByName(spark.createDataFrame([(99, None)], "row_id long, v array<float>")).createOrReplaceTempView("vecs")
    r = spark.sql("SELECT row_id, cosine_sim(v, v) c, dot(v, v) d, vec_norm(v) n, unrotate(rotate(v)) u, int4_encode(rotate(v)) k, v FROM vecs").collect()
    for row in r:
        if row.v is None:
            assert row.c is None and row.u is None and row.k is None
        else:
            assert abs(row.c - 1) < 1e-12 and abs(row.d - row.n**2) < 1e-9 and len(row.k) == 64
            assert np.abs(np.array(row.u) * row.n - np.array(row.v)).max() < 1e-4
    path = str(tmp_path / "ix")
    builder = IndexBuilder.create(spark, path, frame(spark, x[:400]), 1, spec=SPEC_64)
    builder.push(frame(spark, x), "row_id")
    builder.commit()
    frame(spark, x[:2], name="query_id").createOrReplaceTempView("asked")
    sqlapi.register_index(spark, "hits", path, "asked", 3)
    assert {(h.query_id, h.row_id) for h in spark.sql("SELECT * FROM hits WHERE rank = 1").collect()} == {(0, 0), (1, 1)}
