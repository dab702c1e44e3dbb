import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import mixing as M
from quillon.llm import packing as P
from quillon.llm import tokens as T

CAPACITIES = [384, 2048, 8192]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from([[100], [10, 100], [7, 30, 100]]))
def test_bins_hold_their_items_in_the_smallest_size_that_does(sizes, capacities):
    place, caps = P.pack_block(sizes, capacities)
    used = [0] * len(caps)
    for b, n in zip(place, sizes):
        used[b] += n
    assert all(u and c == min(x for x in capacities if x >= u) for u, c in zip(used, caps))
    if len(capacities) == 1:  # no two bins could be one
        assert all(a + b > 100 for i, a in enumerate(used) for b in used[i + 1 :])


def test_an_item_too_large_is_refused_and_a_costly_size_avoided():
    with pytest.raises(ValueError):
        P.pack_block([101], [10, 100])
    assert P.pack_block([10] * 10, [10, 100])[1] == [100]
    assert P.pack_block([10] * 10, [10, 100], lambda c: c**2)[1] == [10] * 10


def sizes(spark, n=3000):
    random.seed(3)
    data = [(i, random.choice("abc") if i % 10 else None, int(random.lognormvariate(5, 1.5)), "x") for i in range(n)]
    data += [(n, "a", 2048, "x"), (n + 1, "a", 2049, "x"), (n + 2, "a", 50_000, "x"), (n + 3, "a", 0, "x"), (None, "a", 9, "x"), (5, data[5][1], data[5][2], "x")]
    return spark.createDataFrame(data, "doc_id long, source string, tokens long, block string"), {r[0]: r[2] for r in data if r[0] is not None and r[2] > 0}


@pytest.mark.parametrize("capacities", [CAPACITIES, [2048, 384]])
def test_every_token_has_its_place_and_only_what_must_be_is_split(spark, capacities):
    df, want = sizes(spark)
    placed = P.pack(df.repartition(5), capacities, block=1000).collect()
    largest, bins, docs = max(capacities), {}, {}
    for r in placed:
        bins.setdefault((r.block, r.bin), []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
    assert {d: sum(r.tokens for r in rs) for d, rs in docs.items()} == want
    for d, rs in docs.items():
        assert [r.tokens for r in sorted(rs, key=lambda r: r.piece)][:-1] == [largest] * (len(rs) - 1)
        assert (len(rs) > 1) == (want[d] > largest)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at
            at += r.tokens
        assert at <= rs[0].capacity and {r.capacity for r in rs} == {min(c for c in capacities if c >= at)}
    filled = sum(want.values()) / sum(rs[0].capacity for rs in bins.values())
    assert filled > 0.98
    report = P.fill_report(spark.createDataFrame(placed, P.PLACED), {384: "e", 2048: "t", 8192: "a"})
    assert report.agg(F.sum("tokens")).first()[0] == sum(want.values())


def test_packing_does_not_depend_on_partitions_and_takes_empty_tables(spark):
    df, _ = sizes(spark, 500)
    a, b = ({tuple(r) for r in P.pack(df.repartition(n), CAPACITIES).collect()} for n in (1, 6))
    assert a == b
    assert P.pack(df.limit(0), CAPACITIES).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, [])
    names = spark.createDataFrame([("trainer", 2048), ("encoder", 384), ("archive", 8192), (None, 5), ("none", None)], "container_name string, capacity_tokens int")
    assert P.named_capacities(names, "trainer") == {384: "encoder", 2048: "trainer"}
    with pytest.raises(ValueError):
        P.named_capacities(names, "other")


def test_shares_are_reached_within_half_a_document_and_no_document_is_overused(spark):
    df, want = sizes(spark)
    plan = [("p", "a", 0.5, 9), ("p", "b", 0.01, 1), ("p", "c", 0.3, 1), ("p", "absent", 0.1, 5), ("q", "b", 1.0, 20), ("q", "b", 1.0, 20), (None, "b", 0.2, 1), ("r", "a", None, 2), ("r", "a", 0.2, None)]
    targets = spark.createDataFrame(plan, "plan_name string, source string, target_share double, max_repeats int")
    docs = df.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    total = sum(want.values())
    got = {(r.plan_name, r.source): r for r in M.shares(docs, targets).collect()}
    assert set(got) == {("p", "a"), ("p", "b"), ("p", "c"), ("p", "absent"), ("q", "b")}
    biggest = 50_000
    for r in got.values():
        assert r.total == total and r.most_copies <= r.max_repeats
        if r.short:
            assert r.reached_tokens == r.max_repeats * r.available < r.target_tokens
        else:
            assert abs(r.reached_tokens - r.target_tokens) <= biggest / 2 + 1
    assert got["p", "absent"].short and got["p", "absent"].available == 0 and got["p", "c"].short
    allocation = M.allocate(docs, targets)
    one, two = ({tuple(r) for r in M.mix(docs.repartition(n), allocation).collect()} for n in (1, 7))
    assert one == two
    per = {}
    for plan_name, source, doc, _, copies in one:
        per.setdefault((plan_name, source), set()).add(copies)
    assert all(max(c) - min(c) <= 1 for c in per.values())
    assert {tuple(r) for r in M.mix(docs, allocation, seed=1).collect()} != one


def test_chances_are_kept(spark):
    """Over many plans every document is drawn about as often as its chance says."""
    docs = spark.createDataFrame([(i, "a", 10) for i in range(60)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(f"p{i}", "a", 0.25, 1) for i in range(200)], "plan_name string, source string, target_share double, max_repeats int")
    drawn = M.mix(docs, M.allocate(docs, targets))
    assert {r["count"] for r in drawn.groupBy("plan_name").count().collect()} == {15}
    per = [r["count"] for r in drawn.groupBy("doc_id").count().collect()]
    assert len(per) == 60 and 25 <= min(per) and max(per) <= 75  # 50 expected, standard deviation 6


def test_unequal_chances_are_kept_and_no_document_exceeds_its_repeats(spark):
    """Documents of 5, 20 and 80 tokens whose chance grows with the root of their size, drawn for many plans."""
    data = [(i, "a", (5, 20, 80)[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(f"p{i}", "a", 0.3, 1) for i in range(300)], "plan_name string, source string, target_share double, max_repeats int")
    allocation = M.allocate(docs, targets)
    drawn = M.mix(docs, allocation, power=0.5)
    per = {r.tokens: r["count"] / (20 * 300) for r in drawn.groupBy("tokens").count().collect()}
    x = 0.3 * sum(t for *_, t in data) / sum(t**1.5 for *_, t in data)
    for t in (5, 20, 80):
        assert per[t] == pytest.approx(x * t**0.5, rel=0.12)
    sums = [r[0] for r in drawn.groupBy("plan_name").agg(F.sum("tokens")).select("sum(tokens)").collect()]
    assert all(abs(n - 630) <= 40 for n in sums)
    # more than the largest can give: those stand at the most, the rest makes up for them
    many = spark.createDataFrame([("p", "a", 0.9, 3)], "plan_name string, source string, target_share double, max_repeats int")
    got = {r.tokens: r.c for r in M.mix(docs, M.allocate(docs, many, total=6000.0), power=1.0).groupBy("tokens").agg(F.avg("copies").alias("c")).collect()}
    assert got[80] == 3 and 1.2 < got[20] < 1.7
    r = M.shares(docs, many.withColumn("target_share", F.lit(9.0)), power=1.0).first()
    assert r.short and r.reached_tokens == 3 * r.available and r.actual_share == 1.0


def test_actual_shares_are_of_the_mix(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(100)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("p", "a", 0.5, 1), ("p", "none", 0.5, 1)], "plan_name string, source string, target_share double, max_repeats int")
    got = {r.source: (r.reached_share, r.actual_share) for r in M.shares(docs, targets).collect()}
    assert got == {"a": (0.5, 1.0), "none": (0.0, 0.0)}


def test_sizes_compete(spark):
    assert {c for c in P.pack_jointly([380] * 40 + [2000] * 9 + [8000], CAPACITIES)[1]} == {384, 2048, 8192}
    assert P.pack_jointly([100] * 20, [128, 2048])[1] == [2048]  # one filled well is cheaper than twenty with room left
    assert P.pack_jointly([128] * 16, [128, 2048])[1] == [128] * 16
    assert P.pack_jointly([], CAPACITIES) == ([], [])
    with pytest.raises(ValueError):
        P.pack_jointly([9], [8])
    many = list(range(100, 1100, 100))
    place, caps = P.pack_jointly([90, 450, 1000, 1000, 30], many)
    assert len(place) == 5 and set(caps) <= set(many)
    names = spark.createDataFrame([("b", 10), ("a", 10), ("c", 20)], "container_name string, capacity_tokens int")
    assert P.named_capacities(names) == {10: "a, b", 20: "c"}


def test_empty_tables(spark):
    df, _ = sizes(spark, 20)
    targets = spark.createDataFrame([("p", "a", 0.5, 9)], "plan_name string, source string, target_share double, max_repeats int")
    assert M.shares(df, targets.limit(0)).count() == 0
    r = M.shares(df.limit(0), targets).first()
    assert r.reached_tokens == 0 and not r.short


@pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary")
def test_sizes_of_null_empty_and_long_texts(spark):
    texts = [None, "", " ", "a b c", "x" * 100_000, "的" * 5000, "<|endoftext|>", "a\x00b"]
    df = spark.createDataFrame([(i, "s", t, "x") for i, t in enumerate(texts)], "doc_id long, source string, text string, tokens string")
    got = {r.doc_id: r.tokens for r in T.sized(df).collect()}
    assert got[0] == got[1] == 0 and got[2] == 1 and got[3] == 3 and got[4] > 1000 and got[5] >= 5000 and got[6] > 1 and got[7] >= 3
    encode = T.encoder(T.VOCABULARY)
    assert all(encode.decode(encode.encode_ordinary(t)) == t for t in texts if t)
