import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.errors import AlreadyExists, Busy, CommitOutcomeUnknown, Conflict, Corrupt, EmptyCommit, IdentityMismatch, InvalidTraining, InvalidVector, NotFound
from quillon.plans import store
from quillon.plans.index import Index, IndexBuilder, collect_garbage, dense_ids
from quillon.plans.store import Files, check_segments, pack_container, unpack_container
from quillon.sources.generated import rows
from quillon.spec import SPEC_64


def frame(spark, x, first=0, name="row_id"):
    return spark.createDataFrame(pd.DataFrame({name: np.arange(first, first + len(x)), "v": [r.tolist() for r in x]}), f"{name} long, v array<float>")


@pytest.fixture(scope="module")
def corpus():
    return rows("correlated", 64, np.arange(900), 4)


@pytest.fixture
def create(spark, corpus, tmp_path):
    def make(name="ix", **more):
        return IndexBuilder.create(spark, str(tmp_path / name), frame(spark, corpus[:400]), 1, spec=SPEC_64, segment_rows=100, **more)

    return make


def hits(index, spark, x):
    return {(h.query_id, h.rank, h.row_id, h.score) for h in index.search(frame(spark, x, name="query_id"), 5).collect()}


def test_one_append_and_several_give_the_same_hits(spark, corpus, create, tmp_path):
    one, many = create("one"), create("many")
    one.push(frame(spark, corpus[400:800]), "row_id")
    assert one.commit().rows_added == 400
    said = []
    for a, b in ((400, 450), (450, 451), (451, 800)):
        ids = many.push(frame(spark, corpus[a:b], a).repartition(3), "row_id")
        assert {(r.row_id, r.row_id) for r in ids.collect()} != set() or a == b
        said.append(many.commit())
    assert [(s.generation, s.first_row, s.rows_added, s.cleanup_complete) for s in said] == [(1, 0, 50, True), (2, 50, 1, True), (3, 51, 349, True)]
    assert said[-1].drift["insufficient"] and not said[-1].drift["warned"]
    a, b = Index.open(spark, str(tmp_path / "one")), Index.open(spark, str(tmp_path / "many"))
    assert (len(a), len(b), a.generation, b.generation, a.segment_count, b.segment_count) == (400, 400, 1, 3, 4, 6)
    assert a.model.identity == b.model.identity
    assert hits(a, spark, corpus[:3]) == hits(b, spark, corpus[:3])
    old = Index.open(spark, str(tmp_path / "many"), generation=1)
    assert len(old) == 50 and {h[2] for h in hits(old, spark, corpus[:3])} <= set(range(50))
    assert [(r.segment, r.first_row, r.row_count) for r in b.certificates.orderBy("segment").collect()][:2] == [(0, 0, 50), (1, 50, 1)]
    with pytest.raises(NotFound):
        Index.open(spark, str(tmp_path / "many"), generation=9)


def test_invalid_rows_are_refused_by_position_and_use_no_id(spark, corpus, create):
    builder = create()
    bad = {"nan": [float("nan")] * 64, "inf": [float("inf")] + [0.0] * 63, "zero": [0.0] * 64, "tiny": [1e-20] + [0.0] * 63, "long": [65_505.0] + [0.0] * 63, "short": [1.0] * 63, "null": None, "hole": [None] + [1.0] * 63}
    for v in bad.values():
        data = [(0, [1.0] * 64), (7, v), (9, [2.0] * 64)]
        with pytest.raises(InvalidVector) as e:
            builder.push(spark.createDataFrame(data, "row_id long, v array<float>"), "row_id")
        assert e.value.position == 1
    ids = builder.push(frame(spark, corpus[400:410], 50), "row_id").collect()
    assert sorted((r["row_id"]) for r in ids) == list(range(10)) or sorted(r[1] for r in ids) == list(range(10))
    assert builder.commit().first_row == 0


def test_create_append_and_commit_refuse_what_they_must(spark, corpus, create, tmp_path):
    builder = create()
    with pytest.raises(EmptyCommit):
        builder.commit()
    with pytest.raises(NotFound):
        Index.open(spark, str(tmp_path / "ix"))
    builder.push(frame(spark, corpus[:0]), "row_id")
    with pytest.raises(EmptyCommit):
        builder.commit()
    builder.push(frame(spark, corpus[:20]), "row_id")
    builder.commit()
    with pytest.raises(AlreadyExists):
        create()
    with pytest.raises(InvalidTraining):
        IndexBuilder.create(spark, str(tmp_path / "no"), frame(spark, corpus[:200]), 1, spec=SPEC_64)
    assert IndexBuilder.append(spark, str(tmp_path / "ix")).first_row == 20


class Failing(Files):
    """Fails at the n-th operation that changes something."""

    def __init__(self, spark, root):
        super().__init__(spark, root)
        self.left, self.late = None, False

    def _count(self):
        if self.left is not None:
            self.left -= 1
            if self.left < 0:
                raise OSError("injected")

    def write(self, name, text):
        self._count()
        super().write(name, text)

    def replace(self, a, b):
        if self.late:
            super().replace(a, b)
            raise OSError("injected after the fact")
        self._count()
        super().replace(a, b)

    def remove(self, name):
        self._count()
        super().remove(name)

    def read(self, name):
        if self.late and name == "CURRENT" and getattr(self, "blind", False):
            raise OSError("injected")
        return super().read(name)


def test_each_failure_leaves_the_old_or_the_new_generation(spark, corpus, create, tmp_path):
    path = str(tmp_path / "ix")
    builder = create()
    builder.push(frame(spark, corpus[:50]), "row_id")
    builder.commit()
    for step in range(4):
        files = Failing(spark, path)
        builder = IndexBuilder.append(spark, path, files=files)
        builder.push(frame(spark, corpus[50:60], 50), "row_id")
        before, files.left = Index.open(spark, path).generation, step
        try:
            report = builder.commit()
            assert report.generation == before + 1
        except OSError:
            assert Index.open(spark, path).generation == before
        files.left = None
    index = Index.open(spark, path)
    assert len(index) == 50 + 10 * (index.generation - 1)


def test_an_outcome_that_cannot_be_known_is_said_to_be_unknown(spark, corpus, create, tmp_path):
    create().push(frame(spark, corpus[:5]), "row_id")
    path = str(tmp_path / "b")
    builder = create("b")
    builder.push(frame(spark, corpus[:5]), "row_id")
    builder.files.__class__ = Failing
    builder.files.left, builder.files.late, builder.files.blind = None, True, True
    with pytest.raises(CommitOutcomeUnknown):
        builder.commit()
    assert Index.open(spark, path).generation == 1


def test_garbage_collection_leaves_strangers_alone(spark, corpus, create, tmp_path):
    builder = create()
    builder.push(frame(spark, corpus[:5]), "row_id")
    builder.commit()
    files = Files(spark, str(tmp_path / "ix"))
    files.write("manifest-7", "x")
    files.write("notes.txt", "x")
    files.write("segments/" + "0" * 32 + "/x", "x")
    files.write("segments/mine/x", "x")
    assert sorted(collect_garbage(files)) == ["manifest-7", "segments/" + "0" * 32]
    assert "notes.txt" in files.names() and "mine" in files.names("segments")
    assert len(Index.open(spark, str(tmp_path / "ix"))) == 5


def test_of_two_builders_the_first_wins_and_nothing_is_lost(spark, corpus, create, tmp_path):
    path = str(tmp_path / "ix")
    builder = create()
    builder.push(frame(spark, corpus[:50]), "row_id")
    builder.commit()
    one, two = IndexBuilder.append(spark, path), IndexBuilder.append(spark, path)
    one.push(frame(spark, corpus[50:60], 50), "row_id")
    two.push(frame(spark, corpus[60:75], 50), "row_id")
    one.commit()  # its clean-up leaves what the other has staged
    assert all(f"segments/{c}" for c in two._staged) and set(two._staged) <= set(Files(spark, path).names("segments"))
    with pytest.raises(Conflict):
        two.commit()
    assert len(Index.open(spark, path)) == 60
    two.discard()
    again = IndexBuilder.append(spark, path)
    again.push(frame(spark, corpus[60:75], 60), "row_id")
    assert again.commit().generation == 3 and len(Index.open(spark, path)) == 75
    assert not [n for n in Files(spark, path).names() if n.startswith(("staging-", "LOCK", "CURRENT."))]


def test_a_lock_is_respected_until_it_expires(spark, corpus, create, tmp_path, monkeypatch):
    builder = create()
    builder.push(frame(spark, corpus[:5]), "row_id")
    files = Files(spark, str(tmp_path / "ix"))
    files.lock("other")
    with pytest.raises(Busy):
        builder.commit()
    files.unlock("mine")
    assert files.exists("LOCK")
    monkeypatch.setattr(store, "LEASE", -1)
    assert builder.commit().generation == 1 and not files.exists("LOCK")


def test_a_crash_between_renames_leaves_the_old_generation(spark, corpus, create, tmp_path):
    builder = create()
    builder.push(frame(spark, corpus[:5]), "row_id")
    builder.commit()
    path, files = tmp_path / "ix", Files(spark, str(tmp_path / "ix"))
    (path / "CURRENT").rename(path / "CURRENT.old")
    assert Index.open(spark, str(path)).generation == 1
    builder.push(frame(spark, corpus[5:9], 5), "row_id")
    assert builder.commit().generation == 2 and "CURRENT.old" not in files.names()
    for move in (files._rename_over, files._rename_aside):
        files.write("a", "new")
        files.write("b", "old")
        assert move("a", "b") in (True, None) and files.read("b") == "new" and not files.exists("a") and not files.exists("b.old")


def test_compaction_keeps_rows_segments_and_former_generations(spark, corpus, create, tmp_path):
    path, builder = str(tmp_path / "ix"), create()
    for a in range(0, 40, 10):
        builder.push(frame(spark, corpus[a : a + 10], a), "row_id")
        builder.commit()
    before = sorted(tuple(r) for r in Index.open(spark, path).rows.collect())
    assert builder.compact(1).generation == 5
    index = Index.open(spark, path)
    assert sorted(tuple(r) for r in index.rows.collect()) == before and len(index.manifest["commits"]) == 1 and len(index.rows.inputFiles()) == 1
    assert len(Index.open(spark, path, 2)) == 20
    builder.push(frame(spark, corpus[40:45], 40), "row_id")
    assert builder.commit().generation == 6 and len(Index.open(spark, path)) == 45


def test_the_training_work_is_kept_with_the_model(spark, create, tmp_path):
    builder = create()
    assert builder.model.baseline["training_iterations"] >= builder.model.spec.subs and builder.model.baseline["training_moves"] > 0


def test_spoilt_files_are_refused(spark, corpus, create, tmp_path):
    builder = create()
    builder.push(frame(spark, corpus[:150]), "row_id")
    builder.commit()
    path = tmp_path / "ix"
    for name in ("CURRENT", "manifest-1", next(p.name for p in path.iterdir() if p.name.startswith("model-"))):
        good = (path / name).read_text()
        for spoilt in (good.replace('\\"', '\\" ', 1), good[: len(good) // 2], good.replace('"version": 1', '"version": 2')):
            for crc in path.glob(".*.crc"):
                crc.unlink()
            (path / name).write_text(spoilt)
            with pytest.raises((Corrupt, IdentityMismatch, Exception)):
                Index.open(spark, str(path))
        (path / name).write_text(good)
    index = Index.open(spark, str(path))
    folder = path / "segments" / index.manifest["commits"][0]
    kept = spark.read.parquet(str(folder)).where("row_id <> 3")
    kept.write.parquet(str(tmp_path / "less"))
    for f in folder.iterdir():
        f.unlink()
    for f in (tmp_path / "less").iterdir():
        f.rename(folder / f.name)
    with pytest.raises(Corrupt):
        Index.open(spark, str(path))


def test_containers_and_segment_lists():
    text = pack_container("manifest", {"a": 1})
    assert unpack_container("manifest", text) == {"a": 1}
    with pytest.raises(IdentityMismatch):
        unpack_container("model", text)
    for cut in range(0, len(text), 7):
        with pytest.raises(Corrupt):
            unpack_container("manifest", text[:cut])
    changed = json.loads(text) | {"payload": '{"a": 2}'}
    with pytest.raises(Corrupt):
        unpack_container("manifest", json.dumps(changed))
    s = lambda i, first, n: {"segment": i, "first_row": first, "row_count": n}
    check_segments([s(0, 0, 5), s(1, 5, 1)], 6)
    for spoilt, total in (([s(0, 1, 5)], 5), ([s(0, 0, 5), s(1, 4, 1)], 6), ([s(0, 0, 5)], 6), ([s(0, 0, 0)], 0)):
        with pytest.raises(Corrupt):
            check_segments(spoilt, total)
    assert store.VERSION == 1


def test_dense_ids_follow_the_order_without_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(1).alias("_p")).repartition(5)
    got = sorted((r.row_id, r.k, r._p) for r in dense_ids(df, ["k"], 10).collect())
    assert got == [(i + 10, i, 1) for i in range(1000)]
    assert dense_ids(df.limit(0), ["k"]).count() == 0
