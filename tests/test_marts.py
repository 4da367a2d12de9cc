"""Business questions on a hand-made set of receipts."""

from __future__ import annotations

import datetime as dt

import pytest

from tests import plans
from tillroll.plans import marts, quality
from tillroll.plans.tables import Tables


def day(month, number=15):
    return dt.datetime(2021, month, number)


@pytest.fixture(scope="module")
def shop(spark):
    receipts = spark.createDataFrame(
        [
            ("r1", "u1", day(3, 2), "FINISHED", 10.0, 2),  # current month: in no window
            ("r2", "u1", day(2), "FINISHED", 20.0, 3),
            ("r3", "u2", day(2), "REJECTED", None, None),
            ("r4", "u2", day(2), "REJECTED", 5.0, None),
            ("r5", "u3", day(1), "SUBMITTED", None, None),
            ("r6", "gone", day(1), "FINISHED", 1.1, 1),
            ("r7", None, None, None, None, None),
        ],
        "receipt_id string, user_id string, date_scanned timestamp, rewards_receipt_status string, "
        "total_spent double, purchased_item_count int",
    )
    items = spark.createDataFrame(
        [
            ("r1", "1", 0.1), ("r2", "1", 0.1), ("r2", "1", 0.2), ("r2", None, 1.0), ("r3", "2", 3.0),
            ("r3", "9", None), ("r5", "1", 7.0), ("r6", "3", 8.0), ("lost", "1", 99.0),
        ],
        "receipt_id string, barcode string, final_price double",
    )
    users = spark.createDataFrame(
        [("u1", day(2), "WI"), ("u1", day(2), "WI"), ("u2", day(1), "IL"), ("u3", dt.datetime(2020, 7, 1), "IL"),
         ("u4", day(3, 20), None)],
        "user_id string, created_date timestamp, state string",
    )
    brands = spark.createDataFrame(
        [("b1", "1", "Oats"), ("b2", "2", "Tea"), ("b3", "3", "Jam"), ("b4", "3", "Jelly")],
        "brand_id string, barcode string, name string",
    )
    return Tables(receipts, items, users, brands)


def got(df):
    return [tuple(r) for r in df.collect()]


def test_top_brands(shop):
    # r4 has no items, r2 and r3 have an item without brand, barcode 3 is ambiguous
    assert got(marts.top_brands(shop, 1)) == [(None, 3), ("Oats", 1), ("Tea", 1)]
    assert got(marts.top_brands(shop, 2)) == [("Oats", 1), (None, 1)]
    assert got(marts.top_brands(shop, 1, k=1)) == [(None, 3)]


def test_rank_change(shop):
    change = {r.brand_name: tuple(r)[1:] for r in marts.brand_rank_change(shop, k=2).collect()}
    assert change == {
        None: (3, 1, 1, 1, 0),
        "Oats": (1, 2, 1, 1, -1),
        "Tea": (1, 2, None, None, None),
    }


def test_statuses(shop):
    spend = [(None, None), ("FINISHED", 31.1 / 3), ("REJECTED", 5.0), ("SUBMITTED", None)]
    assert sorted(got(marts.status_avg_spend(shop.receipts)), key=repr) == sorted(spend, key=repr)
    items = dict(got(marts.status_items(shop.receipts)))
    assert items == {None: None, "FINISHED": 6, "REJECTED": None, "SUBMITTED": None}
    assert got(marts.status_compare(shop.receipts)) == [
        ("average_spent", 31.1 / 3, 5.0, "FINISHED"),
        ("total_items_purchased", 6.0, None, None),
    ]
    assert marts.status_avg_spend(shop.receipts).collect()[-1].rewards_receipt_status is None


def test_new_users(shop):
    # today is March 20th: the window is September to February, so u1 and u2
    spend = got(marts.new_user_brand_spend(shop))
    assert spend == [("Tea", 3.0), (None, 1.0), ("Oats", 0.4)]
    transactions = got(marts.new_user_brand_transactions(shop))
    assert transactions == [(None, 3, 1.0), ("Oats", 2, 0.4), ("Tea", 1, 3.0)]
    assert dict(spend) == {name: spent for name, _, spent in transactions}
    assert got(marts.new_user_top_brand(shop)) == [("Oats", 2, 0.4)]
    assert got(marts.new_user_top_spend(shop)) == [("Tea", 3.0)]


def test_daily_brand_receipts(shop):
    daily = {(r.day, r.brand_name): r.distinct_receipts for r in marts.daily_brand_receipts(shop).collect()}
    assert daily[(day(2).date(), None)] == 3 and daily[(day(2).date(), "Oats")] == 1
    assert daily[(None, None)] == 1


def test_star_view_keeps_every_receipt(shop):
    star = quality.star_view(shop)
    plain = (
        shop.receipts.join(shop.users_dedup, "user_id", "left").drop("user_id")
        .join(shop.items, "receipt_id", "left").join(shop.brands_cleaned, "barcode", "left")
    )
    assert star.count() == plain.count() == 10
    (r3,) = star.filter("r_receipt_id = 'r3' AND i_barcode = '2'").collect()
    assert (r3.u_state, r3.b_name, r3.i_final_price) == ("IL", "Tea", 3.0)


def test_issue_report(shop):
    report = {r.issue: (r.affected, r.out_of, r.share_pct) for r in quality.issue_report(shop).collect()}
    assert report == {
        "duplicate rows": (1, 5, 20.0),
        "barcode of several brands": (2, 4, 50.0),
        "receipts without items": (2, 7, 28.6),
        "receipt users without user record": (1, 4, 25.0),
        "item barcodes without brand": (2, 4, 50.0),
        "brand barcodes without items": (0, 2, 0.0),
        "items without barcode": (1, 9, 11.1),
        "status ACCEPTED never used": (1, 1, 100.0),
    }


def test_whole_star_sends_items_once(spark):
    receipts = spark.range(20).selectExpr("string(id) AS receipt_id", "string(id % 5) AS user_id")
    items = spark.range(2000).selectExpr("string(id % 20) AS receipt_id", "IF(id % 2 = 0, string(id % 7), NULL) AS barcode")
    users = spark.range(5).selectExpr("string(id) AS user_id", "'WI' AS state")
    brands = spark.range(5).selectExpr("string(id) AS barcode", "concat('b', id) AS name")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        star = quality.star_view(Tables(receipts, items, users, brands))
        rows = star.collect()
        sent = plans.records_sent(star)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(rows) == 2000 and sum(r.b_name is not None for r in rows) == sum(i % 2 == 0 and i % 7 < 5 for i in range(2000))
    # Each item to its receipt, those with a barcode to the brands before; receipts, users, brands and keys besides.
    assert sent < 2000 + 1000 + 500
