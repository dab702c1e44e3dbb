import numpy as np
import pytest

from quillon.llm import neighbours as N

SCHEMA = "vec_id long, corpus string, split_name string, embedding array<float>, added_at timestamp, shard string"


def table(spark, rows):
    return spark.createDataFrame([(i, c, s, None if v is None else [None if x is None else float(x) for x in v], None, "x") for i, c, s, v in rows], SCHEMA)


def brute(rows, k=10):
    out = {}
    for c in {r[1] for r in rows}:
        index = [(i, np.array(v, np.float32).astype(float)) for i, d, s, v in rows if d == c and s == "indexed"]
        ids = np.array([i for i, _ in index])
        x = np.stack([v / np.linalg.norm(v) for _, v in index]) if index else None
        for i, d, s, v in rows:
            if d == c and s == "queries" and len(ids):
                q = np.array(v, np.float32).astype(float)
                out[i] = ids[N.rank(ids, x @ (q / np.linalg.norm(q)), k)].tolist()
    return out


@pytest.fixture(scope="module")
def clean():
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((20, 64)) * 2
    make = lambda n: (centers[rng.integers(0, 20, n)] + rng.standard_normal((n, 64))) * rng.uniform(0.01, 9, (n, 1))
    rows, at = [], 0
    for corpus, sizes in (("big", (3000, 200, 80)), ("small", (7, 0, 3))):
        for split, n in zip(("indexed", "calibration", "queries"), sizes):
            for v in make(n) if n else []:
                rows.append((at, corpus, split, v.astype(np.float32)))
                at += 1
    return rows


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_vec_id, r["rank"])):
        got.setdefault(r.query_vec_id, []).append(r.near_vec_id)
    return got


def test_recall_against_brute_force(spark, clean):
    got, want = found(N.nearest(table(spark, clean))), brute(clean)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    assert all(len(got[q]) == min(10, 7 if q >= 3280 else 3000) for q in got)


def test_queries_dealt_to_blocks_find_the_same(spark, clean):
    df = table(spark, clean)
    assert found(N.nearest(df, query_group=9)) == found(N.nearest(df))
    report = {r.corpus: r for r in N.fit_all(N.usable(df), 9).collect()}
    assert report["big"].blocks == 9 and report["small"].blocks == 1
    assert {r.corpus: r.share_scored for r in N.index_report(df).collect()}["big"] < 0.34


def test_dirty_rows_ties_copies_and_equal_directions(spark, clean):
    some = [r for r in clean if r[1] == "small"]
    base = next(r[3] for r in some if r[2] == "queries")
    rows = list(some) + [(5000 + i, "small", "indexed", base * np.float32(2.0 ** (i % 3))) for i in range(15)]
    bad = [(6000, "small", "indexed", None), (6001, "small", "indexed", [1.0] * 63), (6002, "small", "queries", [float("nan")] * 64), (6003, "small", "indexed", [0.0] * 64), (6004, "small", "indexed", [None] + [1.0] * 63), (6005, None, "indexed", [1.0] * 64), (None, "small", "indexed", [1.0] * 64), (6006, "lonely", "queries", [1.0] * 64), (6007, "small", " Queries ", base), (6008, "small", None, base)]
    got = found(N.nearest(table(spark, [*rows, *rows[:9], *bad])))
    want = brute([*rows, (6007, "small", "queries", base)])
    assert got == want
    assert got[6007] == list(range(5000, 5010))


def test_empty_tables_and_no_queries(spark, clean):
    assert N.nearest(table(spark, [])).count() == 0
    assert N.nearest(table(spark, [r for r in clean if r[1] == "small" and r[2] == "indexed"])).count() == 0
    assert N.nearest(table(spark, [r for r in clean if r[1] == "small" and r[2] == "queries"])).count() == 0


def test_the_walk_visits_cells_by_summed_distance(spark):
    rng = np.random.default_rng(3)
    for _ in range(30):
        d1, d2, sizes = rng.random(6), rng.random(5), rng.integers(0, 4, (6, 5))
        want = rng.integers(1, sizes.sum() + 1)
        reach = N.walk(d1, d2, sizes, want)
        sums = d1[:, None] + d2
        assert sizes[sums <= reach].sum() >= want > sizes[sums < reach].sum()
    assert N.walk(d1, d2, sizes, sizes.sum() + 1) == float("inf")


def test_a_long_walk_is_ended_by_halving_with_the_same_result(monkeypatch):
    rng = np.random.default_rng(8)
    for n in range(40):
        d1, d2, sizes = rng.integers(0, 30, 40) / 7, rng.random(40), rng.integers(0, 4, (40, 40))
        want = rng.integers(1, sizes.sum() + 1)
        monkeypatch.setattr(N, "HEAP", 10**9)
        whole = N.walk(d1, d2, sizes, want)
        monkeypatch.setattr(N, "HEAP", 5 + n)
        assert N.walk(d1, d2, sizes, want) == pytest.approx(whole, abs=1e-12)
    assert N.walk(d1, d2, sizes, sizes.sum() + 1) == float("inf")


def test_a_hot_cell_is_dealt_to_several_shards(monkeypatch):
    monkeypatch.setattr(N, "SHARD_ROWS", 100)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.standard_normal((1, 64)), 300, axis=0), rng.standard_normal((300, 64))]).astype(np.float32)
    m = N.fit("c", x, x[:0], 6000)
    assert m.salts.max() >= 30 and m.count >= 60
    taken = [range(s, s + n) for s, n in zip(m.shards, m.salts) if n > 1]
    assert all(s not in r for r in taken for s, n in zip(m.shards, m.salts) if n == 1)


def test_ties_are_ordered_by_id():
    ids, s = np.array([5, 3, 9, 1]), np.array([0.5, 0.5 + 1e-13, 0.5 - 1e-13, 0.4])
    assert ids[N.rank(ids, s, 3)].tolist() == [3, 5, 9]
    assert len(N.rank(ids[:0], s[:0], 3)) == 0
    assert np.allclose(N._unit(np.array([[1e-30, 0], [1e30, 1e30]], np.float32)), [[1, 0], [0.5**0.5] * 2])
