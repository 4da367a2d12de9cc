"""Cleaned tables, stored aggregates and states that follow their batches."""

from __future__ import annotations

import json
from datetime import date, datetime
from functools import reduce
from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.plans import records_sent, scans
from tillroll import schemas
from tillroll.operators import linkage
from tillroll.operators.joins import with_match
from tillroll.operators.keys import dedup_rows, drop_ambiguous_keys
from tillroll.plans import daily, marts, refresh, states
from tillroll.plans.tables import Tables
from tillroll.streaming.daily import read_daily_counts, start_daily_counts


def frame(spark, table, *rows):
    """Rows of a table from the columns given; the others are NULL."""
    kinds = {f.name: f.dataType for f in schemas.TABLES[table]}
    data = [tuple(r.get(c) for c in kinds) for r in rows]
    return spark.createDataFrame(data, schemas.TABLES[table])


def brands(spark, *pairs):
    return frame(spark, "brands", *({"brand_id": i, "barcode": b, "name": f"n{i}"} for i, b in pairs))


def rows(df):
    return sorted(map(str, df.collect()))


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_second_brand_retracts_the_first(spark, tmp_path):
    root, table = str(tmp_path), refresh.BRANDS_CLEANED
    one = brands(spark, *((f"a{i}", f"c{i}") for i in range(40)))
    refresh.apply_batch(spark, root, table, "one", one)
    before = files(tmp_path / "clean")
    two = brands(spark, ("b1", "c7"), ("b2", "new"))
    changes = refresh.apply_batch(spark, root, table, "two", two)
    assert sorted((r.brand_id, r.change) for r in changes.collect()) == [("a7", "removed"), ("b2", "added")]
    assert rows(refresh.read_clean(spark, root, table)) == rows(drop_ambiguous_keys(one.union(two), "barcode"))
    # Only the hash partitions of the two keys were replaced.
    after = files(tmp_path / "clean")
    touched = {k.split("/")[0] for k in after.items() ^ before.items() for k in [k[0]]}
    assert 1 <= len(touched) <= 2 < len({k.split("/")[0] for k in after})
    # The batch again without that brand: the first one is back.
    changes = refresh.apply_batch(spark, root, table, "two", brands(spark, ("b2", "new")))
    assert sorted((r.brand_id, r.change) for r in changes.collect()) == [("a7", "added")]
    assert rows(refresh.read_clean(spark, root, table)) == rows(drop_ambiguous_keys(one.union(brands(spark, ("b2", "new"))), "barcode"))
    refresh.apply_batch(spark, root, table, "two", two.where("false"))
    assert rows(refresh.read_clean(spark, root, table)) == rows(one)


def test_missing_barcodes_follow_not_in(spark, tmp_path):
    root, table = str(tmp_path), refresh.BRANDS_CLEANED
    batches = [[("a", "1"), ("b", None)], [("c", "2"), ("d", "2")], [("e", None)], [("f", "3")]]
    so_far = brands(spark)
    for i, pairs in enumerate(batches):
        refresh.apply_batch(spark, root, table, f"b{i}", brands(spark, *pairs))
        so_far = so_far.union(brands(spark, *pairs))
        assert rows(refresh.read_clean(spark, root, table)) == rows(drop_ambiguous_keys(so_far, "barcode"))


def test_failed_refresh_can_be_repeated(spark, tmp_path, monkeypatch):
    root, table = str(tmp_path), refresh.BRANDS_CLEANED
    one, two = brands(spark, ("a", "1"), ("b", "2")), brands(spark, ("c", "1"))
    refresh.apply_batch(spark, root, table, "one", one)
    with monkeypatch.context() as m:
        m.setattr(refresh.attempts, "apply", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            refresh.apply_batch(spark, root, table, "two", two)
    changes = refresh.apply_batch(spark, root, table, "two", two)
    assert sorted((r.brand_id, r.change) for r in changes.collect()) == [("a", "removed")]
    assert rows(refresh.read_clean(spark, root, table)) == rows(brands(spark, ("b", "2")))


def test_users_dedup(spark, tmp_path):
    root, table = str(tmp_path), refresh.USERS_DEDUP
    one = frame(spark, "users", *({"user_id": f"u{i}", "role": "x"} for i in range(30)))
    two = frame(spark, "users", {"user_id": "u3", "role": "x"}, {"user_id": "u4", "role": "y"}, {"user_id": None})
    refresh.apply_batch(spark, root, table, "one", one.union(one))
    changes = refresh.apply_batch(spark, root, table, "two", two.union(two))
    assert sorted((str(r.user_id), r.change) for r in changes.collect()) == [("None", "added"), ("u4", "added")]
    assert rows(refresh.read_clean(spark, root, table)) == rows(dedup_rows(one.union(two)))


def day_rows(spark, *pairs):
    """Receipts (id, day of July 2021 or none) and two items each, of barcodes 1 and 2."""
    receipts = frame(spark, "receipts", *({"receipt_id": r, "date_scanned": d and datetime(2021, 7, d, 5)} for r, d in pairs))
    items = frame(spark, "items", *({"receipt_id": r, "barcode": b} for r, _ in pairs for b in ("1", "2")))
    return receipts, items


def test_stored_days(spark, tmp_path):
    store, catalogue = daily.DayStore(str(tmp_path)), brands(spark, ("x", "1"), ("y", "2"))
    first = day_rows(spark, *((f"r{i}", 1 + i % 9) for i in range(18)), ("none", None))
    aug = frame(spark, "receipts", {"receipt_id": "last", "date_scanned": datetime(2021, 8, 3)}), frame(spark, "items")
    daily.add_batch(spark, store, "first", *(a.union(b) for a, b in zip(first, aug, strict=True)))
    assert daily.refresh(spark, store, catalogue) == [None, *(f"2021-07-0{i}" for i in range(1, 10)), "2021-08-03"]
    kept = files(tmp_path / "daily")
    late = day_rows(spark, ("late", 4), ("later", 5))
    daily.add_batch(spark, store, "late", *late)

    def whole(*batches):
        receipts, items = (reduce(DataFrame.union, side) for side in zip(*batches, strict=True))
        return Tables(receipts, items, frame(spark, "users"), catalogue)

    # The two stale days are counted from their own items, the others come from what is stored.
    top = daily.top_brands(spark, store, catalogue)
    every = whole(first, aug, late)
    assert rows(top) == rows(marts.top_brands(every)) and top.first().distinct_receipts == 20
    read = scans(top)
    items = [s for s in read if "barcode" in s["plan"] and "receipt_id" in s["plan"]]
    assert items and all(s["partitions"] <= 4 for s in items)  # two days of two batches
    by_days = daily.top_brands_of_days(spark, store, catalogue)
    assert rows(by_days) == rows(top)
    assert daily.refresh(spark, store, catalogue) == ["2021-07-04", "2021-07-05"]
    assert rows(daily.read_daily(spark, store)) == rows(marts.daily_brand_receipts(every))
    now = files(tmp_path / "daily")
    assert {k.split("/")[0] for k, _ in set(now.items()) ^ set(kept.items())} == {"since=2021-07-04", "since=2021-07-05"}
    # The late batch again with one receipt less: its day is counted anew; a day without receipts goes.
    daily.add_batch(spark, store, "late", *day_rows(spark, ("later", 5)))
    assert daily.refresh(spark, store, catalogue) == ["2021-07-04", "2021-07-05"]
    assert rows(daily.read_daily(spark, store)) == rows(marts.daily_brand_receipts(whole(first, aug, day_rows(spark, ("later", 5)))))


def test_retracted_brands_make_days_stale(spark, tmp_path):
    store = daily.DayStore(str(tmp_path / "days"), "month")
    root, table = str(tmp_path / "brands"), refresh.BRANDS_CLEANED
    one, two = brands(spark, ("x", "1"), ("y", "2")), brands(spark, ("z", "1"))
    refresh.apply_batch(spark, root, table, "one", one)
    receipts, items = day_rows(spark, ("a", 1), ("b", 2))
    daily.add_batch(spark, store, "first", receipts, items)
    daily.refresh(spark, store, one)
    daily.note_brand_changes(spark, store, refresh.apply_batch(spark, root, table, "two", two))
    assert daily.refresh(spark, store, one.union(two)) == ["2021-07-01"]
    tables = Tables(receipts, items, frame(spark, "users"), one.union(two))
    assert rows(daily.read_daily(spark, store)) == rows(marts.daily_brand_receipts(tables))


def test_states_add_up(spark, tmp_path):
    root = str(tmp_path)
    left, right = (spark.createDataFrame(x, "k string") for x in ([("a",), ("a",), ("b",), (None,)], [("a",), ("c",), (None,), (None,)]))
    more = spark.createDataFrame([("a",), ("c",), (None,)], "k string")
    for batch, l, r in (("one", left, right), ("two", right, right), ("two", more, left)):
        states.add_states(spark, root, batch, {"l": (l, "k"), "r": (r, "k")})
    merged = [states.merged(spark, root, n) for n in "lr"]
    assert rows(states.linkage_profile(*merged)) == rows(linkage.linkage_profile(left.union(more), right.union(left), "k"))
    assert rows(states.linkage_summary(*merged)) == rows(linkage.linkage_summary(left.union(more), right.union(left), "k"))
    got = states.column_profile(merged[0], "k").first()
    assert got[:] == ("k", 7, 3, 1, 2, 28.6)
    assert states.merged(spark, str(tmp_path / "none"), "l").count() == 0


def test_late_receipts_are_counted_apart(spark, tmp_path):
    def put(*days):
        lines = [json.dumps({"_id": {"$oid": f"{d}-{i}"}} | ({"createDate": {"$date": 86_400_000 * d}} if d else {})) for i, d in enumerate(days)]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))

    run = lambda: start_daily_counts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log"), delay="3 days", files=1).awaitTermination()
    read = lambda: {(r.day - date(1970, 1, 1)).days if r.day else None: (r.day_rows, r.late_rows) for r in read_daily_counts(spark, str(tmp_path / "out")).collect()}
    assert read() == {}
    put(100, 100, 99, None)
    put(100, 98, 97, 96, 50, 50)
    run()
    assert read() == {None: (1, 0), 100: (3, 0), 99: (1, 0), 98: (1, 0), 97: (1, 0), 96: (1, 1), 50: (2, 2)}
    put(50, 101)
    run()
    assert sum(n for n, _ in read().values()) == 12 and read()[50][0] == 3 and read()[101] == (1, 0)


def test_batches_of_one_table_are_placed_at_once(spark, tmp_path):
    # "both" is a receipt of either batch, on other days; "open" has no receipt, as the item without an id.
    first, _ = day_rows(spark, ("a", 1), ("both", 2), ("none", None))
    late, _ = day_rows(spark, ("both", 4), ("b", 4), ("b", 4))
    items = frame(spark, "items", *({"receipt_id": r, "barcode": b} for r in ("a", "both", "none", "b", "open", None) for b in ("1", None)))
    apart, at_once = daily.DayStore(str(tmp_path / "apart")), daily.DayStore(str(tmp_path / "at-once"))
    arriving = first.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    placed = daily.placed(at_once, arriving, items, "late").filter("late IS NOT NULL")
    for name, receipts, which in (("first", first, "NOT late"), ("late", late, "late")):
        daily.add_batch(spark, apart, name, receipts, with_match(items, receipts, "receipt_id"))
        daily.add_batch(spark, at_once, name, receipts, placed.filter(which).drop("late"))
    for table in ("receipts", "items"):
        assert rows(daily.stored(spark, at_once, table)) == rows(daily.stored(spark, apart, table))


def test_daily_counts_send_items_to_their_receipts_once(spark):
    receipts, _ = day_rows(spark, *((f"r{i}", 1 + i % 9) for i in range(200)), (None, 3))
    items = frame(spark, "items", *({"receipt_id": f"r{i}", "barcode": b} for i in range(190) for b in ("1", "2", None)))
    tables = Tables(receipts, items, frame(spark, "users"), brands(spark, ("x", "1"), ("y", "2")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        daily_counts = marts.daily_brand_receipts(tables)
        found = {(r.day.day, r.brand_name): r.distinct_receipts for r in daily_counts.collect()}
        sent = records_sent(daily_counts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {(d, b): len(range(d - 1, 190, 9)) if b else len(range(d - 1, 200, 9)) for d in range(1, 10) for b in ("nx", "ny", None)}
    # Items with a barcode to the brands, all items and their receipts once, and each receipt that has items.
    assert sent <= 190 * 2 + 190 * 3 + 200 + 190 + 250
