import pytest
from pyspark.sql import functions as F

from quillon.operators.drift import merge_reservoirs, nearest_rank, reservoir
from quillon.operators.select import KEY_BITS, key_of_hash, smallest_per_group

SCHEMA = "g string, id long, key long, q double, w double, _own string, _edge int"


def table(spark, n):
    """One group holds most rows, one is null; keys as hashes give them, some equal."""
    data = []
    for i in range(n):
        g = "hot" if i % 3 else ("a", "b", None)[i // 3 % 3]
        key = (i * 0x9E3779B97F4A7C15 ^ i << 7) % (1 << KEY_BITS) if i % 50 else 12345
        data.append((g, i, key, 40.0, float(i % 7), "x", i))
    return spark.createDataFrame(data, SCHEMA), data


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_the_smallest_keys_of_each_group_whatever_the_buckets(spark, bits):
    df, data = table(spark, 2000)
    got = {(r.g, r.id, r._own, r._edge) for r in smallest_per_group(df.repartition(7), ["g"], "key", "q", ["id"], bucket_bits=bits).collect()}
    want = set()
    for g in ("hot", "a", "b", None):
        want |= {(r[0], r[1], r[5], r[6]) for r in sorted((r for r in data if r[0] == g), key=lambda r: (r[2], r[1]))[:40]}
    assert got == want


def test_weights_end_within_half_a_row_of_the_quota(spark):
    df, data = table(spark, 1500)
    kept = smallest_per_group(df.withColumn("q", F.lit(500.0)), ["g"], "key", "q", ["id"], weight="w", bucket_bits=4)
    for r in kept.groupBy("g").agg(F.sum("w").alias("w")).collect():
        total = sum(x[4] for x in data if x[0] == r.g)
        assert abs(r.w - min(500, total)) <= 3


def test_quotas_beyond_the_group_nulls_and_empty_tables(spark):
    df, _ = table(spark, 30)
    assert smallest_per_group(df.withColumn("q", F.lit(1e9)), ["g"], "key", "q", ["id"]).count() == 30
    assert smallest_per_group(df.withColumn("q", F.lit(0.0)), ["g"], "key", "q", ["id"]).count() == 0
    assert smallest_per_group(df.withColumn("key", F.lit(None).cast("long")), ["g"], "key", "q", ["id"]).count() == 0
    assert smallest_per_group(df.limit(0), ["g"], "key", "q", ["id"]).count() == 0


def test_a_reservoir_does_not_depend_on_batches(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"))
    whole = {r.row_id for r in reservoir(df, key_of_hash("row_id"), 100).collect()}
    state = reservoir(df.where("row_id < 700"), key_of_hash("row_id"), 100)
    for low, high in ((700, 701), (701, 5000)):
        state = merge_reservoirs(state, df.where(f"row_id >= {low} AND row_id < {high}"), key_of_hash("row_id"), 100)
    assert len(whole) == 100 and {r.row_id for r in state.collect()} == whole


def test_nearest_ranks_with_ties_nulls_and_single_rows(spark):
    data = [("a", float(v)) for v in [1, 1, 1, 2, 9]] + [("b", 7.0), ("c", None)]
    got = {r.g: (r.x_p50, r.x_p95, r.x_p99, r.x_n) for r in nearest_rank(["x"], (50, 95, 99), ["g"], spark.createDataFrame(data, "g string, x double")).collect()}
    assert got == {"a": (1.0, 9.0, 9.0, 5), "b": (7.0, 7.0, 7.0, 1)}
