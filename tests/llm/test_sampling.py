import hashlib
import math
import uuid

import pytest
from pyspark.sql import functions as F

from quillon.llm import sampling
from quillon.operators.select import key_of_hash

IDS = ["00112233445566778899aabbccddeeff", "ffeeddccbbaa99887766554433221100"]
ROWS = "index_id string, row_id long, generation int, priority string, added_at timestamp, rate string, _id int"
INDEXES = "index_id string, index_name string, sample_permille int"


def true_key(row, index):
    return int(hashlib.sha256(row.to_bytes(8, "little", signed=True) + bytes.fromhex(index)).hexdigest()[:13], 16)


@pytest.fixture
def tables(spark):
    spelt = lambda i, n: (IDS[i], IDS[i].upper(), str(uuid.UUID(IDS[i])), f" {{{uuid.UUID(IDS[i])}}} ", f"0x{IDS[i]}")[n % 5]
    data = [(spelt(i, r), r, r // 100, "wrong", None, "x", 1) for i, n in ((0, 900), (1, 40)) for r in range(n)]
    data += [(spelt(0, r), r, 8, None, None, None, None) for r in range(0, 900, 7)]  # come again, later
    data += [(None, 5, 1, None, None, None, None), (IDS[0], None, 1, None, None, None, None), ("unknown", 5, 1, None, None, None, None), ("ab" * 16, 5, 1, None, None, None, None), (IDS[0], -3, None, None, None, None, None)]
    return spark.createDataFrame(data, ROWS), spark.createDataFrame([(IDS[0], "a", 125), (IDS[1], "b", 500), ("12" * 16, "none", 10)], INDEXES)


def test_the_threshold_sample(spark, tables):
    got = {(r.index_id, r.row_id) for r in sampling.threshold_sample(*tables).select("index_id", "row_id").collect()}
    want = {(IDS[i], r) for i, rs, p in ((0, [*range(900), -3], 125), (1, range(40), 500)) for r in rs if true_key(r, IDS[i]) * 1000 < p << 52}
    assert got == want


def test_batches_keep_exactly_their_share_and_never_lose_a_row(spark, tables):
    shown = sampling.shown_rows(*tables).cache()
    draw = lambda df: {(r.index_id, r.generation, r.row_id) for r in sampling.frozen_batches(df, "index_id", "generation", "key", "rate", ["row_id"]).collect()}
    whole = draw(shown)
    assert whole == draw(shown.repartition(5))
    for g in range(9):
        early = draw(shown.where(f"generation <= {g}"))
        assert early <= whole and early == {x for x in whole if x[1] <= g}
        batch = [r for r in range(900) if r // 100 == g]
        best = sorted(batch, key=lambda r: (true_key(r, IDS[0]), r))[: math.ceil(0.125 * len(batch))]
        assert {x[2] for x in whole if x[0] == IDS[0] and x[1] == g} == set(best)


def test_rates_ties_nulls_and_clashing_names(spark):
    df = spark.range(200).select("id", F.lit("s").alias("sample"), (F.col("id") % 2).alias("batch"), F.lit(7).cast("long").alias("key"), F.lit(0.07).alias("rate"), F.lit("q").alias("_quota"), F.lit(1).alias("_edge"))
    kept = sampling.frozen_batches(df, "sample", "batch", "key", "rate", ["id"])
    assert kept.columns == df.columns
    assert sorted(r.id for r in kept.collect()) == list(range(14))  # equal keys: the lower ids, 7 a batch and not 8
    assert sampling.frozen_batches(df.withColumn("rate", F.lit(0.0)), "sample", "batch", "key", "rate", ["id"]).count() == 0
    assert sampling.frozen_batches(df.withColumn("rate", F.lit(1.0)), "sample", "batch", "key", "rate", ["id"]).count() == 200
    none = df.withColumn("sample", F.lit(None).cast("string")).withColumn("key", F.when(F.col("id") < 100, F.col("key")))
    assert sampling.frozen_batches(none, "sample", "batch", "key", "rate", ["id"]).count() == 8
    assert sampling.frozen_batches(df.limit(0), "sample", "batch", "key", "rate", ["id"]).count() == 0


def test_one_batch_may_hold_nearly_all_rows(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(-1).alias("batch"), F.lit(0).alias("sample"), key_of_hash("id").alias("key"), F.lit(0.01).alias("rate"))
    kept = sampling.frozen_batches(df, "sample", "batch", "key", "rate", ["id"])
    assert kept.where("batch = -1").count() == 198 and kept.count() == 398


def test_growth_and_empty_tables(spark, tables):
    rows, indexes = tables
    grown = sampling.sample_growth(rows, indexes).where(F.col("index_id") == IDS[0]).orderBy("generation").collect()
    assert [r.batch_seen for r in grown] == [1] + [100] * 9 and [r.batch_sampled for r in grown] == [1] + [13] * 9
    assert grown[-1].seen_count == 901 and grown[-1].sample_size == 1 + 9 * 13
    assert sampling.threshold_sample(rows.limit(0), indexes).count() == 0
    assert sampling.threshold_sample(rows, indexes.limit(0)).count() == 0


def test_published_totals_beside_those_counted(spark, tables):
    commits = spark.createDataFrame(
        [(IDS[0].upper(), 0, None, 101, 5, "x"), (IDS[0], 0, None, 100, 99, "x"), (IDS[0], 1, None, None, 7, "x"), (IDS[0], None, None, 1, 1, "x"), ("unknown", 1, None, 1, 1, "x"), (IDS[1], 99, None, 3, 3, "x")],
        "index_id string, generation int, committed_at timestamp, seen_count long, sample_size long, _c string",
    )
    got = {(r.index_id, r.generation): r for r in sampling.growth_and_commits(*tables, commits).collect()}
    assert set(got) == {(IDS[0], 0), (IDS[0], 1), (IDS[1], 99)}
    assert got[IDS[0], 0].seen_agrees and got[IDS[0], 0].seen_count == 101 and got[IDS[0], 0].batch_size == 14
    assert not got[IDS[0], 1].seen_agrees and got[IDS[0], 1].published_seen is None and got[IDS[0], 1].seen_count == 201
    assert got[IDS[1], 99].seen_count is None and not got[IDS[1], 99].seen_agrees
    assert sampling.growth_and_commits(*tables, commits.limit(0)).count() == 0
