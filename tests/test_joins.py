"""Property: the salted hot-key join returns exactly the plain join's rows."""

import contextlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from keyedit.operators.joins import can_broadcast, change_stats, keyed_join

KEYS = st.one_of(st.none(), st.integers(0, 6))


@settings(max_examples=5, deadline=None)
@given(big=st.lists(st.tuples(KEYS, st.integers(0, 9)), min_size=1, max_size=120),
       small=st.lists(st.tuples(KEYS, st.integers(0, 9)), min_size=0, max_size=30))
def test_salted_join_equals_plain_join(spark, big, small):
    b = spark.createDataFrame(big + [(0, 1)] * 40, "k long, a long")        # key 0 is hot
    s = spark.createDataFrame(small, "k long, c long")
    spark.conf.set("keyedit.skew.hotRows", "10")
    spark.conf.set("keyedit.skew.rowsPerBucket", "5")
    try:
        for how in ("left", "inner", "left_semi", "left_anti"):
            plain = sorted(map(tuple, b.join(s, ["k"], how).collect()), key=str)
            salted_df = keyed_join(b, s, ["k"], how, small_fits=False)
            salted = sorted(map(tuple, salted_df.select(*b.join(s, ["k"], how).columns).collect()), key=str)
            assert plain == salted, how
    finally:
        spark.conf.unset("keyedit.skew.hotRows")
        spark.conf.unset("keyedit.skew.rowsPerBucket")


@contextlib.contextmanager
def _conf(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_size_checks(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "c"), (2, None)], "k long, v string")
    st_ = change_stats(df, "k")
    assert st_["rows"] == 3 and st_["dup_keys"] == 1 and st_["bytes"] == 3 * (8 + 16) + (2 + 7) + (1 + 7)
    assert can_broadcast(df)
    assert not can_broadcast(df, max_rows=2)
    assert not can_broadcast(df, max_bytes=10)


def test_salted_join_with_a_map_column(spark):
    b = spark.createDataFrame([(0, {"a": i}) for i in range(30)] + [(1, {"b": 1})], "k long, m map<string,int>")
    s = spark.createDataFrame([(0, "x"), (1, "y")], "k long, c string")
    spark.conf.set("keyedit.skew.hotRows", "10")
    try:
        out = keyed_join(b, s, ["k"], "inner", small_fits=False)
        assert out.count() == 31
    finally:
        spark.conf.unset("keyedit.skew.hotRows")


def test_bucket_count_follows_the_size_of_each_hot_key(spark):
    from keyedit.operators.joins import hot_keys
    b = spark.createDataFrame([(1, i) for i in range(95)] + [(2, i) for i in range(25)] + [(3, 0)], "k long, a long")
    got = {r["k"]: r["__buckets"] for r in hot_keys(b, ["k"], hot_rows=20, rows_per_bucket=10).collect()}
    assert got == {1: 10, 2: 3}


def _most_in_a_task(df):
    n = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(n) / (sum(n) / 8)


@pytest.mark.parametrize("how", ["left", "left_anti", "inner", "left_semi"])
def test_null_keys_stay_out_of_the_shuffle(spark, how):
    """Half of the rows have no key: no task gets them all, and results are those of a plain join."""
    b = spark.range(0, 20000, 1, 8).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("a"))
    s = spark.range(0, 15000, 3).select(F.col("id").alias("k"), F.lit("x").alias("c"))
    with _conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        out = keyed_join(b, s, ["k"], how, small_fits=False)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, b.join(s, ["k"], how).collect()), key=str)
        if how in ("left", "left_anti"):
            assert _most_in_a_task(out) < 2


def test_equal_rows_of_a_hot_key_are_split(spark):
    """A key-only projection with half of its rows under one key."""
    b = spark.range(0, 20000, 1, 8).select(F.when(F.col("id") % 2 == 0, F.lit(77)).otherwise(F.col("id")).cast("long").alias("k"))
    s = spark.range(0, 20000).select(F.col("id").alias("k"), F.lit("x").alias("c"))
    with _conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                       "keyedit.skew.hotRows": "1000", "keyedit.skew.rowsPerBucket": "100"}):
        out = keyed_join(b, s, ["k"], "inner", small_fits=False, equal_rows=True)
        assert _most_in_a_task(out) < 2
        assert out.count() == 20000


def test_row_bytes_bound_the_row_format(spark):
    from keyedit.operators.joins import measured_size
    df = spark.range(10).select(*[F.col("id").alias(f"c{i}") for i in range(20)])
    assert measured_size(df) == (10, 10 * (8 + 160))
