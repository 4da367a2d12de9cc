"""Hot and missing keys: work is split, results stay whole."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tillroll.operators import joins, keys, linkage
from tillroll.plans import marts
from tillroll.plans.tables import Tables

N = 120_000
SMALL_PARTITIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
}


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """One receipt, one barcode and one user with a third of the rows; as many barcodes missing."""
    n = spark.range(0, N, 1, 8)
    third = F.col("id") % 3
    items = n.select(
        F.when(third == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 5000)).alias("receipt_id"),
        F.when(third == 1, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("b"), F.col("id") % 400)).alias("barcode"),
        ((F.col("id") % 100) / 4).alias("final_price"),
    )
    receipts = spark.range(0, 6000, 1, 4).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("r"), "id")).alias("receipt_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 700)).alias("user_id"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 600).alias("date_scanned"),
    )
    users = spark.range(0, 800, 1, 2).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("user_id"),
        F.timestamp_seconds(F.lit(1_600_000_000) - F.col("id") * 40_000).alias("created_date"),
    )
    brands = spark.range(0, 500, 1, 2).select(
        F.concat(F.lit("B"), "id").alias("brand_id"),
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("b"), "id")).alias("barcode"),
        F.concat(F.lit("n"), F.col("id") % 40).alias("name"),
    )
    return Tables(receipts, items, users.unionAll(users), brands)


def test_aqe_splits_hot_keys(spark, hot):
    with settings(spark, SMALL_PARTITIONS):
        joined = joins.left_join_heavy_right(hot.receipts, hot.items, "receipt_id")
        assert len(joined.collect()) == joined.count()
        assert "SortMergeJoin(skew=true)" in plan(joined)
        named = joins.left_join_missing_keys(hot.items, hot.brands, "barcode", "receipt_id")
        assert len(named.collect()) == N
        assert "SortMergeJoin(skew=true)" in plan(named)
        plain = hot.receipts.join(hot.items, "receipt_id", "left")
        assert joined.count() == plain.count()
        assert joined.agg(F.sum("final_price")).first() == plain.agg(F.sum("final_price")).first()


def test_missing_keys_are_spread(spark):
    left = spark.range(0, N, 1, 8).select(
        F.col("id").cast("string").alias("row"), F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).alias("k")
    )
    right = spark.range(0, N, 4, 4).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))

    def largest_share(df):
        sizes = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
        return sizes[0] / sizes[1]

    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        assert largest_share(left.join(right, "k", "left")) > 0.7
        spread = joins.left_join_missing_keys(left, right, "k", "row")
        assert largest_share(spread) < 0.2
        # The exchange of the left side carries the spread: nothing folded it away.
        exchanges = [line for line in plan(spread).splitlines() if "Exchange hashpartitioning" in line]
        assert any("hash(row" in line for line in exchanges)


def test_missing_keys_match_nothing(spark):
    left = spark.createDataFrame([(None, "a"), ("x", "b"), ("y", "c"), (None, "d"), ("x", "e")], "k string, row string")
    right = spark.createDataFrame([(None, 1), ("x", 2), (None, 3), ("z", 4)], "k string, v int")
    for threshold in ("-1", "10MB"):
        with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": threshold}):
            got = joins.left_join_missing_keys(left, right, "k", "row").collect()
            assert sorted(map(tuple, got), key=lambda r: r[1]) == [(None, "a", None), ("x", "b", 2), ("y", "c", None), (None, "d", None), ("x", "e", 2)]


def test_marts_on_hot_keys_equal_plain_sql(spark, hot):
    views = {
        "receipts": hot.receipts, "items": hot.items, "users": hot.users_dedup, "brands": hot.brands_cleaned,
    }
    month = "date_trunc('month', (SELECT max({c}) FROM {t}))"
    this_month = month.format(c="date_scanned", t="{receipts}")
    top = spark.sql(
        f"""SELECT name, count(DISTINCT r.receipt_id) n FROM {{receipts}} r
            LEFT JOIN {{items}} i ON r.receipt_id = i.receipt_id LEFT JOIN {{brands}} b ON i.barcode = b.barcode
            WHERE date_scanned >= {this_month} - INTERVAL 1 MONTH AND date_scanned < {this_month}
            GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 5""",
        **{k: views[k] for k in ("receipts", "items", "brands")},
    )
    user_month = month.format(c="created_date", t="{users}")
    spend = spark.sql(
        f"""SELECT name, count(DISTINCT r.receipt_id) n, cast(sum(cast(final_price AS decimal(18,2))) AS double) s
            FROM {{receipts}} r JOIN {{users}} u ON r.user_id = u.user_id
            LEFT JOIN {{items}} i ON r.receipt_id = i.receipt_id LEFT JOIN {{brands}} b ON i.barcode = b.barcode
            WHERE created_date >= {user_month} - INTERVAL 6 MONTH AND created_date < {user_month} GROUP BY 1""",
        **views,
    )
    want_top, want_spend = top.collect(), {tuple(r) for r in spend.collect()}
    assert len(want_top) == 5 and len(want_spend) > 5
    with settings(spark, SMALL_PARTITIONS):
        assert [tuple(r) for r in marts.top_brands(hot).collect()] == [tuple(r) for r in want_top]
        assert {tuple(r) for r in marts.new_user_brand_transactions(hot).collect()} == want_spend
        assert {tuple(r) for r in marts.new_user_brand_spend(hot).collect()} == {(a, c) for a, _, c in want_spend}


def test_counts_shrink_before_the_shuffle(spark, hot):
    """A hot key is one row per task when it is shuffled, and no join is made for linkage."""
    for df in (
        linkage.linkage_profile(hot.items, hot.brands, "barcode"),
        keys.duplicate_keys(hot.items, "barcode"),
        keys.dedup_rows(hot.users),
    ):
        text = plan(df)
        assert "Join" not in text
        partial = text.index("HashAggregate", text.index("Exchange hashpartitioning"))
        assert partial > 0


def test_plans_stay_inside_the_jvm(spark, hot):
    for df in (marts.top_brands(hot), marts.brand_rank_change(hot), marts.new_user_brand_transactions(hot)):
        text = plan(df)
        assert not any(op in text for op in ("Python", "CartesianProduct", "BroadcastNestedLoop"))
