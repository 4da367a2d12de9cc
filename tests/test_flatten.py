"""Ingest and flattening on toy documents, one per trap."""

from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillroll import schemas
from tests.plans import largest_method
from tillroll.operators.flatten import (
    FLATTEN,
    accepted,
    flatten_brands,
    flatten_items,
    flatten_receipts,
    flatten_users,
    rejected,
)
from tillroll.sources.jsonl import (
    EmptySourceError,
    parse_lines,
    read_jsonl,
    require_documents,
)


def documents(spark, *lines):
    texts = [(line if isinstance(line, str) else json.dumps(line),) for line in lines]
    return parse_lines(spark.createDataFrame(texts, "value string"))


def reasons(rows):
    return sorted(r.reject_reason for r in rejected(rows).collect())


def oid(value):
    return {"_id": {"$oid": value}}


def test_lines(spark, tmp_path):
    path = tmp_path / "users.json"
    path.write_text(
        '  {"_id": {"$oid": "a"}}  \n\n   \t\n{"_id": {"$oid": "b"} oops\n{"_id": {"$oid": "c"}} oops\n'
        '{"_id": {"$oid": "d"}},{"x": 1}\n[1]\nnull\n42\n'
        "{'_id': {'$oid': 'e'}}\n{\"_id\": {\"$oid\": \"f\"}, \"role\": \"x\", \"role\": \"y\"}\n"
        '{"_id": {"$oid": "g"}] oops\n'
    )
    docs = read_jsonl(spark, str(path))
    errors = [r.line_error for r in docs.collect()]
    assert errors.count("not valid JSON") == 5
    assert errors.count("not an object") == 3
    users = flatten_users(docs)
    assert {r.user_id: r.role for r in accepted(users).collect()} == {"a": "CONSUMER", "f": "y"}
    assert reasons(users) == ["not an object"] * 3 + ["not valid JSON"] * 5
    assert accepted(users).count() == 2 and rejected(users).count() == 8


def test_strict_source_fails_as_a_whole(spark, tmp_path):
    path = tmp_path / "receipts.json"
    path.write_text('{"_id": {"$oid": "a"}}\n{"_id": \n')
    with pytest.raises(PySparkException, match="undecodable line"):
        accepted(flatten_receipts(read_jsonl(spark, str(path), "strict"))).collect()
    with pytest.raises(PySparkException, match="undecodable line"):
        accepted(flatten_items(read_jsonl(spark, str(path), "strict"))).count()
    path.write_text('{"_id": {"$oid": "a"}}\n[1]\n')
    assert accepted(flatten_receipts(read_jsonl(spark, str(path), "strict"))).count() == 1
    with pytest.raises(ValueError, match="mode"):
        read_jsonl(spark, str(path), "sloppy")


def test_each_line_is_parsed_once(spark, tmp_path):
    path = tmp_path / "receipts.json"
    path.write_text(json.dumps(oid("a")))
    rows = accepted(flatten_items(read_jsonl(spark, str(path)))).filter("final_price > 5")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "_partition" in plan
    assert rows.columns == [f.name for f in schemas.ITEMS]


def test_empty_source(spark, tmp_path):
    path = tmp_path / "users.json"
    path.write_text("\n{oops\n")
    with pytest.raises(EmptySourceError):
        require_documents(read_jsonl(spark, str(path)), "users")
    path.write_text('{"a": 1}\n')
    assert require_documents(read_jsonl(spark, str(path)), "users").count() == 1


def test_table_columns_and_types(spark):
    for name, flatten in (
        ("receipts", flatten_receipts),
        ("items", flatten_items),
        ("users", flatten_users),
        ("brands", flatten_brands),
    ):
        got = accepted(flatten(documents(spark, oid("a"))))
        want = schemas.TABLES[name]
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want]
    assert [len(schemas.TABLES[t].fields) for t in schemas.TABLES] == [14, 13, 7, 9]


def test_id_must_be_an_object(spark):
    rows = flatten_users(documents(spark, {}, {"_id": "a"}, {"_id": {"$oid": None}}, {"_id": {"oid": 1}}))
    assert accepted(rows).count() == 0
    assert reasons(rows) == ["document has no id"] * 3 + ["user_id: null"]


def test_receipt_defaults_never_fire(spark):
    full = oid("a") | {
        "bonusPointsEarned": 5.0,
        "createDate": {"$date": 1609459200123},
        "dateScanned": "2021-01-01",
        "finishedDate": None,
        "pointsEarned": "12.50",
        "purchasedItemCount": 2.5,
        "totalSpent": 26,
        "userId": "u",
        "rewardsReceiptStatus": "FINISHED",
    }
    nulls = oid("c") | {"pointsEarned": None, "totalSpent": None, "purchasedItemCount": None}
    rows = accepted(flatten_receipts(documents(spark, full, oid("b"), nulls)))
    a, b, c = rows.orderBy("receipt_id").collect()
    assert a.bonus_points_earned == 5 and a.points_earned == 12.5 and a.total_spent == 26.0
    assert a.create_date == dt.datetime(2021, 1, 1, 0, 0, 0, 123000)
    assert a.date_scanned is None and a.finished_date is None
    assert a.purchased_item_count == 3  # halves go away from zero
    for row in (b, c):
        assert row.points_earned is None and row.total_spent is None
        assert row.purchased_item_count is None


def test_receipt_rejects(spark):
    rows = flatten_receipts(
        documents(
            spark,
            oid("a") | {"totalSpent": "abc"},
            oid("b") | {"pointsEarned": ""},
            oid("c") | {"createDate": {"$date": "2021-01-01T00:00:00Z"}},
            oid("d") | {"createDate": {"$date": "1609459200123"}},
            oid("e") | {"createDate": {"$date": None}},
            oid("f") | {"createDate": {"$date": 1e18}},
            oid("x" * 25),
            oid("g") | {"bonusPointsEarned": 3e9, "userId": {"a": 1}},
        )
    )
    assert accepted(rows).count() == 0
    assert reasons(rows) == sorted(
        [
            "total_spent: not a number",
            "points_earned: not a number",
            *["create_date: not epoch milliseconds"] * 4,
            "receipt_id: longer than 24",
            "bonus_points_earned: not a whole number; user_id: not a text",
        ]
    )


NUMBERS = [
    ("12.50", 12.5), (" 7 ", 7.0), ("1_000", 1000.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0),
    ("+2", 2.0), ("-inf", float("-inf")), ("Infinity", float("inf")), ("nan", None), (3, 3.0),
    (True, 1.0), (1.25, 1.25), (1e300, 1e300), (-4, -4.0),
]
NO_NUMBERS = ["abc", "", "1.5d", "1__0", "_1", "0x10", None, [1], {"a": 1}, "1 2", "true"]


def test_numbers(spark):
    items = [{"finalPrice": text, "barcode": str(i)} for i, (text, _) in enumerate(NUMBERS)]
    rows = accepted(flatten_items(documents(spark, oid("a") | {"rewardsReceiptItemList": items})))
    got = {int(r.barcode): r.final_price for r in rows.collect()}
    assert got == {i: value for i, (_, value) in enumerate(NUMBERS)}


def test_bad_numbers(spark):
    items = [{"finalPrice": text} for text in NO_NUMBERS]
    rows = flatten_items(documents(spark, oid("a") | {"rewardsReceiptItemList": items}))
    want = ["final_price: not a number"] * (len(NO_NUMBERS) - 1) + ["final_price: null"]
    assert accepted(rows).count() == 0
    assert reasons(rows) == want


def test_json_nan_is_missing(spark):
    rows = flatten_receipts(
        documents(spark, '{"_id": {"$oid": "a"}, "totalSpent": NaN, "bonusPointsEarned": NaN}')
    )
    (row,) = accepted(rows).collect()
    assert row.total_spent is None and row.bonus_points_earned is None


def test_item_defaults_fire_only_for_missing_keys(spark):
    items = [
        {},
        {"quantityPurchased": None, "needsFetchReview": None, "barcode": None},
        {"quantityPurchased": 2, "needsFetchReview": True, "barcode": "4011", "partnerItemId": 7},
    ]
    rows = accepted(flatten_items(documents(spark, oid("a") | {"rewardsReceiptItemList": items})))
    empty, nulls, full = rows.collect()
    assert empty.final_price == 0.0 and empty.item_price == 0.0 and empty.user_flagged_price == 0.0
    assert empty.quantity_purchased == 0 and empty.user_flagged_quantity == 0
    assert empty.needs_fetch_review is False and empty.user_flagged_new_item is False
    assert empty.barcode is None and empty.receipt_id == "a"
    assert nulls.quantity_purchased is None and nulls.needs_fetch_review is None
    assert full.quantity_purchased == 2 and full.needs_fetch_review is True
    assert full.barcode == "4011" and full.partner_item_id == "7"


def test_item_lists(spark):
    rows = flatten_items(
        documents(
            spark,
            oid("a"),
            oid("b") | {"rewardsReceiptItemList": []},
            oid("c") | {"rewardsReceiptItemList": "none"},
            oid("d") | {"rewardsReceiptItemList": {"barcode": "1"}},
            {"rewardsReceiptItemList": [{}]},
            oid("e") | {"rewardsReceiptItemList": [{}, "x", None, 1], "totalSpent": "bad"},
        )
    )
    assert [r.receipt_id for r in accepted(rows).collect()] == ["e"]
    assert reasons(rows) == ["item is not an object"] * 3
    assert sorted(r.source for r in rejected(rows).collect()) == ['"x"', "1", "null"]


def test_user_defaults(spark):
    rows = flatten_users(
        documents(
            spark,
            oid("a"),
            oid("b") | {"role": None, "active": None, "state": "WI"},
            oid("c") | {"role": "staff", "active": False, "createdDate": {"$date": 0}},
            oid("d") | {"state": "Wisconsin", "active": 3},
        )
    )
    a, b, c = accepted(rows).orderBy("user_id").collect()
    assert (a.role, a.active) == ("CONSUMER", True)
    assert (b.role, b.active, b.state) == (None, None, "WI")
    assert (c.role, c.active) == ("staff", False)
    assert c.created_date == dt.datetime(1970, 1, 1)
    assert reasons(rows) == ["state: longer than 2; active: not true or false"]


def test_brand_reference(spark):
    rows = flatten_brands(
        documents(
            spark,
            oid("a") | {"cpg": {"$id": {"$oid": "c"}, "$ref": "Cogs"}, "name": "N"},
            oid("b"),
            oid("c") | {"cpg": {"$id": "text", "$ref": "Cpgs"}, "topBrand": None},
            oid("d") | {"cpg": None},
            oid("e") | {"cpg": "text"},
        )
    )
    a, b, c = accepted(rows).orderBy("brand_id").collect()
    assert (a.cpg_id, a.cpg_ref, a.name, a.top_brand) == ("c", "Cogs", "N", False)
    assert (b.cpg_id, b.cpg_ref, b.top_brand) == (None, None, False)
    assert (c.cpg_id, c.cpg_ref, c.top_brand) == (None, "Cpgs", None)
    assert reasons(rows) == ["cpg: not an object"] * 2


def test_flattening_is_compiled(spark):
    """The JVM leaves methods of more than 8000 bytes interpreted."""
    for table, flatten in FLATTEN.items():
        rows = flatten(documents(spark, oid("a")))
        assert max(largest_method(rows), largest_method(accepted(rows))) < 8000, table


def test_plain_and_quoted_values_read_alike(spark):
    """Plain values skip their JSON; what stands in quotes, is null or odd does not."""
    values = [5, "5", "5.0", 5.0, "+5", " 5", True, "true", "TRUE", None, "null", {"a": 1}, [5], 99999999999, "x"]
    items = [{"partnerItemId": str(n), "quantityPurchased": v, "finalPrice": v, "needsFetchReview": v} for n, v in enumerate(values)]
    rows = flatten_items(documents(spark, oid("a") | {"rewardsReceiptItemList": items})).collect()
    by_id = {int(r.partner_item_id): r for r in rows}
    assert [by_id[n].quantity_purchased for n in range(len(values))] == [5, 5, None, 5, 5, 5, None, None, None, None, None, None, None, None, None]
    assert [by_id[n].final_price for n in range(len(values))] == [5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 1.0, None, None, None, None, None, None, 99999999999.0, None]
    assert [by_id[n].needs_fetch_review for n in range(len(values))] == [None, None, None, None, None, None, True, True, True, None, None, None, None, None, None]


def test_fields_are_not_looked_up_one_by_one(spark):
    """A path that leads nowhere is left by an exception, and most fields of most items are missing."""
    # Items: the id, also for the filter on it, the list, and the element of a reject. Brands: the reference.
    lookups = {"receipts": 0, "items": 4, "users": 0, "brands": 1}
    for table, flatten in FLATTEN.items():
        rows = flatten(documents(spark, oid("a")))
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"variant_get\([^$]*\$\[", plan)) <= lookups[table], (table, plan)


def test_computed_lines_are_computed_once(spark):
    """The filter on blank lines doesn't write a computed text again."""
    rows = spark.range(3).select(F.to_json(F.struct("id")).alias("value"))
    plan = parse_lines(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJson") == 1, plan


def test_rejects_name_their_own_element(spark):
    """The source text of a reject is looked up by its place in the list."""
    items = [{"barcode": "a"}, None, "text", {"finalPrice": None, "barcode": "b"}, [1], {"quantityPurchased": "x"}]
    rows = flatten_items(documents(spark, oid("a") | {"rewardsReceiptItemList": items}, oid("b") | {"rewardsReceiptItemList": "none"}, {"rewardsReceiptItemList": items}))
    found = {r.source: r.reject_reason for r in rejected(rows).collect()}
    assert found == {
        "null": "item is not an object",
        '"text"': "item is not an object",
        '{"barcode":"b","finalPrice":null}': "final_price: null",
        "[1]": "item is not an object",
        '{"quantityPurchased":"x"}': "quantity_purchased: not a whole number",
    }
    assert [(r.receipt_id, r.barcode) for r in accepted(rows).collect()] == [("a", "a")]


def test_dates_and_whole_numbers_at_the_edge_of_the_plain(spark):
    stamps = [0, 99_999_999_999_999, 100_000_000_000_000, 253_402_300_799_999, 253_402_300_800_000, -1, "5", 1.5e12, None, "x"]
    wholes = [999_999_999, 1_000_000_000, 2_147_483_647, 2_147_483_648, -999_999_999, -0.4, "-7", "007", 2.5, None]
    lines = [oid(str(n)) | {"createDate": {"$date": d}, "bonusPointsEarned": w} for n, (d, w) in enumerate(zip(stamps, wholes, strict=True))]
    rows = {int(r.receipt_id): r for r in flatten_receipts(documents(spark, *lines)).selectExpr("*", "unix_millis(create_date) AS millis").collect()}
    assert [rows[n].millis for n in range(10)] == [0, 99_999_999_999_999, 100_000_000_000_000, 253_402_300_799_999, None, -1, None, 1_500_000_000_000, None, None]
    assert [rows[n].bonus_points_earned for n in range(10)] == [999_999_999, 1_000_000_000, 2_147_483_647, None, -999_999_999, 0, -7, 7, 3, None]
    bad = "create_date: not epoch milliseconds"
    assert [rows[n].reject_reason for n in range(10)] == [None, None, None, "bonus_points_earned: not a whole number", bad, None, bad, None, bad, bad]
