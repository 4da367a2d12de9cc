"""Operators on small frames: traps, and agreement with the plain form of a join."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillroll.functions.calendar import in_window, month_window
from tillroll.operators import checks, joins, keys, linkage, ranking


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, name, values):
    return spark.createDataFrame([(v, f"{name}{i}") for i, v in enumerate(values)], f"k string, {name} string")


KEYS = st.lists(st.sampled_from([None, "a", "b", "c"]), max_size=6)
FEW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


@FEW
@given(left=KEYS, right=KEYS)
def test_left_joins_equal_the_plain_join(spark, left, right):
    a, b = frame(spark, "x", left), frame(spark, "y", right)
    plain = rows(a.join(b, "k", "left").select("k", "x", "y"))
    assert rows(joins.left_join_missing_keys(a, b, "k", "x")) == plain
    assert rows(joins.left_join_heavy_right(a, b, "k")) == plain


def test_spread_rows_do_not_match_by_accident(spark):
    a = spark.createDataFrame([(None, "b")], "k string, x string")
    b = spark.createDataFrame([("b", "y")], "k string, y string")
    assert rows(joins.left_join_missing_keys(a, b, "k", "x")) == [(None, "b", None)]


@FEW
@given(left=KEYS, right=KEYS)
def test_not_in_equals_sql(spark, left, right):
    a, b = frame(spark, "x", left), frame(spark, "y", right)
    want = spark.sql("SELECT * FROM {a} WHERE k NOT IN (SELECT k FROM {b})", a=a, b=b)
    assert rows(joins.not_in(a, b, "k")) == rows(want)


@FEW
@given(left=KEYS, right=KEYS)
def test_linkage_equals_the_join(spark, left, right):
    a, b = frame(spark, "x", left), frame(spark, "y", right)
    joined = a.join(b.withColumnRenamed("k", "r"), F.col("k") == F.col("r"), "left").agg(
        F.count(F.lit(1)), F.count("k"), F.count_distinct("k"), F.count("r"), F.count_distinct("r")
    )
    assert rows(linkage.linkage_profile(a, b, "k")) == rows(joined)
    s = linkage.linkage_summary(a, b, "k").first()
    assert s.left_keys == s.matched_keys + s.left_orphans
    assert s.right_keys == s.matched_keys + s.right_orphans
    assert s.left_null_rows == left.count(None) and s.right_null_rows == right.count(None)


def test_not_in_plans_no_forced_broadcast(spark):
    a, b = spark.range(10).toDF("k"), spark.range(5).toDF("k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.not_in(a, b, "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan


def test_composite_key_parts_do_not_run_together(spark):
    df = spark.createDataFrame([("1", "23"), ("12", "3"), (None, "3"), ("1", None)], "a string, b string")
    profile = keys.key_profile(df, ["a", ("a", "b")]).first()
    assert tuple(profile) == (4, 2, 2)


def test_duplicates(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 1), ("b", 1), ("c", 1), ("c", 2), (None, 1), (None, 1)], "k string, v int"
    )
    assert rows(keys.duplicate_keys(df, "k")) == [("a", 2), ("c", 2), (None, 2)]
    assert keys.duplicate_key_count(df, "k").first()[0] == 3
    assert tuple(keys.duplicate_excess(df, "k").first()) == (7, 4, 3)
    assert tuple(keys.duplicates_are_exact(df.filter("k <> 'c'"), "k").first()) == (2, 2, True)
    assert tuple(keys.duplicates_are_exact(df.filter("k > ''"), "k").first()) == (4, 3, False)
    # NULL twice is a NULL in the subquery: nothing qualifies
    assert rows(keys.drop_ambiguous_keys(df, "k")) == []
    assert rows(keys.drop_ambiguous_keys(df.filter("k > ''"), "k")) == [("b", 1)]
    assert [r.v for r in keys.rows_with_duplicate_keys(df, "k").collect()] == [1, 1, 1, 2]


def test_dedup_is_idempotent_and_verified(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("b", None)], "k string, v int")
    once = keys.dedup_rows(df)
    assert rows(once) == rows(keys.dedup_rows(once)) == [("a", 1), ("b", None)]
    assert keys.verify_unique(once, "k", "users") is once
    conflicting = df.union(spark.createDataFrame([("a", 2)], "k string, v int"))
    with pytest.raises(keys.NotUniqueError, match="users: 3 rows, 2 distinct k"):
        keys.verify_unique(keys.dedup_rows(conflicting), "k", "users")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_month_window(spark, kind):
    stamps = [dt.datetime(2021, 3, 31, 12), dt.datetime(2021, 2, 1), dt.datetime(2021, 1, 31, 23, 59, 59)]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp").select(F.col("ts").cast(kind))
    window = month_window(df, "ts", 1)
    assert tuple(window.first()) == (dt.datetime(2021, 2, 1), dt.datetime(2021, 3, 1))
    assert [f.dataType.typeName() for f in window.schema] == [kind] * 2
    assert [r.ts for r in df.filter(in_window("ts", window)).collect()] == [stamps[1]]
    assert month_window(df, "ts", 6).first().lo == dt.datetime(2020, 9, 1)


def test_window_reaches_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = orders.filter(in_window("o_orderdate", month_window(orders, "o_orderdate", 1)))
    plan = df.select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "o_orderkey" in line)
    assert "cast(o_orderdate" not in scan and "GreaterThanOrEqual" in plan or ">= " in scan


def test_checks(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "long")], "k string, v string")
    assert rows(checks.null_profile(df, ["k", "v"])) == [("k", 3, 1, 33.3), ("v", 3, 1, 33.3)]
    assert rows(checks.domain_check(df, "k", ["a", "b"])) == [
        ("a", 2, True, "ok"), ("b", 0, True, "absent"), (None, 1, False, "unexpected"),
    ]
    assert rows(checks.too_long(df, {"k": 1, "v": 3})) == [(None, "long", "v")]
    assert checks.fits(df, {"k": 1, "v": 3}).count() == 2
    assert rows(checks.key_violations(df, "k")) == [("a", 2), (None, 1)]
    kept, review = joins.split_missing_keys(df, "k")
    assert (kept.count(), review.count()) == (2, 1)
    empty = checks.null_profile(df.limit(0), ["k"]).first()
    assert (empty.total_rows, empty.null_pct) == (0, None)


def test_rank_equals_the_window_function(spark):
    data = [("x", "a", 5), ("x", "b", 5), ("x", "c", 3), ("x", "d", 9), ("y", "a", 1)]
    df = spark.createDataFrame(data, "g string, name string, n int")
    want = spark.sql("SELECT g, n, name, rank() OVER (PARTITION BY g ORDER BY n DESC) FROM {df}", df=df)
    assert rows(ranking.rank_within(df, "g", "n", "pos").select("g", "n", "name", "pos")) == rows(want)
    assert rows(ranking.leaders(df.filter("n < 9"), "n").select("name")) == [("a",), ("b",)]
    assert [r.name for r in ranking.top_k(df, 3, "n", "name").collect()] == ["d", "a", "b"]


def test_money(spark):
    from tillroll.functions.numbers import money_avg, money_parts, money_sum, money_total

    def of(*amounts):
        df = spark.createDataFrame([(a,) for a in amounts], "x double")
        two_steps = df.groupBy("x").agg(money_parts(F.col("x")).alias("p")).agg(money_total(F.col("p"))).first()[0]
        total, mean = df.agg(money_sum(F.col("x")), money_avg(F.col("x"))).first()
        assert len(set(amounts)) < len(amounts) or str(two_steps) == str(total)
        return total, mean

    assert of(1.005, 0.004, -0.002)[0] == 1.01 and of(1.004, 0.004)[0] == 1.01
    assert of(1e17, 1.0)[0] == 1e17 + 1
    assert of(1e30, 1.0)[0] == 1e30
    assert of(2.0, float("inf")) == (float("inf"), float("inf"))
    assert str(of(2.0, float("nan"))) == "(nan, nan)"
    assert of(None) == (None, None) and of(2.0, None, 4.0) == (6.0, 3.0)


def test_spreading_needs_no_common_type(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k int, name string")
    right = spark.createDataFrame([(1, "x"), (0, "y")], "k int, v string")
    got = joins.left_join_missing_keys(left, right, "k", "name").collect()
    assert sorted((r.name, r.v) for r in got) == [("a", "x"), ("b", None), ("c", None)]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from tillroll import session

    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")

    class Unset:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Cluster:
        sparkContext, conf = Context, Unset

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Cluster, "x")
