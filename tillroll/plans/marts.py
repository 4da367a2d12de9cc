"""Answers to the business questions.

Rules they share: items whose barcode names no brand, and receipts without items, count
under the NULL brand; a brand is its name; spend is the items' ``final_price``; a
transaction is a receipt; "today" is the newest timestamp of the table in question, and
only whole months count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.calendar import in_window, month_window
from tillroll.functions.numbers import money_avg, money_parts, money_total
from tillroll.operators.joins import left_join_missing_keys, split_missing_keys, without_match
from tillroll.operators.ranking import leaders, rank_within, top_k
from tillroll.plans.tables import Tables


def _brand_names(tables: Tables) -> DataFrame:
    return tables.brands_cleaned.select("barcode", F.col("name").alias("brand_name"))


def _no_brand() -> Column:
    return F.lit(None).cast("string").alias("brand_name")


def receipt_brands(tables: Tables, receipts: DataFrame, *carried: str) -> DataFrame:
    """Receipt and brand name for each item of the given receipts, plus receipts without
    items: ``receipts LEFT JOIN items LEFT JOIN brands``, with neither a hot receipt nor
    the missing barcodes in one task."""
    items = tables.items.select("receipt_id", "barcode")
    receipts = receipts.select("receipt_id", *carried)
    bought = receipts.join(items, "receipt_id")
    named = left_join_missing_keys(bought, _brand_names(tables), "barcode", "receipt_id")
    empty = without_match(receipts, items, "receipt_id")
    return named.select("receipt_id", *carried, "brand_name").unionByName(
        empty.select("receipt_id", *carried, _no_brand())
    )


def _scanned(tables: Tables, back_from: int, back_to: int) -> DataFrame:
    window = month_window(tables.receipts, "date_scanned", back_from, back_to)
    return tables.receipts.filter(in_window("date_scanned", window))


def brand_counts(tables: Tables, receipts: DataFrame) -> DataFrame:
    """Receipts per brand among the given ones."""
    named = receipt_brands(tables, receipts)
    return named.groupBy("brand_name").agg(F.count_distinct("receipt_id").alias("distinct_receipts"))


def top_brands(tables: Tables, back: int = 1, k: int = 5) -> DataFrame:
    """Top brands by receipts scanned in the month ``back`` months ago."""
    month = _scanned(tables, back, back - 1)
    return top_k(brand_counts(tables, month), k, "distinct_receipts", "brand_name")


def brand_rank_change(tables: Tables, k: int = 5) -> DataFrame:
    """Brands ranked among the first ``k`` last month or the month before, and how their
    rank changed (positive: up). Ties share a rank; a brand without receipts has none."""
    split = month_window(tables.receipts, "date_scanned", 1).select("lo").scalar()
    recent = F.col("date_scanned") >= split
    both = _scanned(tables, 2, 0).withColumn(
        "period", F.when(recent, F.lit("recent")).otherwise(F.lit("previous"))
    )
    counts = (
        receipt_brands(tables, both, "period")
        .groupBy("brand_name", "period")
        .agg(F.count_distinct("receipt_id").alias("receipts"))
    )
    ranked = rank_within(counts, "period", "receipts", "brand_rank")

    def of(period: str, column: str, name: str) -> Column:
        return F.max(F.when(F.col("period") == period, F.col(column))).alias(name)

    compared = ranked.groupBy("brand_name").agg(
        of("recent", "receipts", "recent_receipts"),
        of("recent", "brand_rank", "recent_rank"),
        of("previous", "receipts", "previous_receipts"),
        of("previous", "brand_rank", "previous_rank"),
    )
    return compared.filter((F.col("recent_rank") <= k) | (F.col("previous_rank") <= k)).withColumn(
        "rank_change", F.col("previous_rank") - F.col("recent_rank")
    )


def status_avg_spend(receipts: DataFrame) -> DataFrame:
    """Average spend per receipt status; NULL where no receipt has an amount."""
    return (
        receipts.groupBy("rewards_receipt_status")
        .agg(money_avg(F.col("total_spent")).alias("average_spent"))
        .orderBy(F.col("rewards_receipt_status").asc_nulls_last())
    )


def status_items(receipts: DataFrame) -> DataFrame:
    """Items purchased per receipt status; NULL where no receipt has a count."""
    return (
        receipts.groupBy("rewards_receipt_status")
        .agg(F.sum("purchased_item_count").alias("total_items_purchased"))
        .orderBy(F.col("rewards_receipt_status").asc_nulls_last())
    )


def status_compare(
    receipts: DataFrame, first: str = "FINISHED", second: str = "REJECTED"
) -> DataFrame:
    """Average spend and items purchased of two statuses, and which is greater."""
    status = F.col("rewards_receipt_status")

    def only(value: str, column: str) -> Column:
        return F.when(status == value, F.col(column))

    def items(value: str) -> Column:
        return F.sum(only(value, "purchased_item_count")).cast("double")

    figures = receipts.filter(status.isin(first, second)).agg(
        *(money_avg(only(s, "total_spent")).alias(f"spend_{i}") for i, s in enumerate((first, second))),
        *(items(s).alias(f"items_{i}") for i, s in enumerate((first, second))),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(measure).alias("measure"),
                F.col(f"{column}_0").alias("first_value"),
                F.col(f"{column}_1").alias("second_value"),
            )
            for measure, column in (("average_spent", "spend"), ("total_items_purchased", "items"))
        )
    )
    greater = (
        F.when(F.col("first_value") > F.col("second_value"), first)
        .when(F.col("first_value") < F.col("second_value"), second)
        .when(F.col("first_value") == F.col("second_value"), "equal")
    )
    return figures.select(F.inline(rows)).withColumn("greater_status", greater)


def _new_user_receipts(tables: Tables, months: int) -> DataFrame:
    """Receipts of users created in the past months, once per matching user row."""
    # max() does not care about copies, so the clock is read before they are removed.
    window = month_window(tables.users, "created_date", months)
    users = tables.users_dedup.filter(in_window("created_date", window)).select("user_id")
    return tables.receipts.select("receipt_id", "user_id").join(users, "user_id").select("receipt_id")


def new_user_brand_spend(tables: Tables, months: int = 6) -> DataFrame:
    """Spend per brand among users created in the past months.

    Prices are added up per barcode before the brand is looked up, so the join sees one
    row per barcode, and one for all items without any.
    """
    receipts = _new_user_receipts(tables, months)
    items = tables.items.select("receipt_id", "barcode", "final_price")
    per_barcode = (
        receipts.join(items, "receipt_id")
        .groupBy("barcode")
        .agg(money_parts(F.col("final_price")).alias("spent"))
    )
    named = per_barcode.join(_brand_names(tables), "barcode", "left").select("brand_name", "spent")
    empty = without_match(receipts, items, "receipt_id").select(
        _no_brand(), F.lit(None).cast(named.schema["spent"].dataType).alias("spent")
    )
    return (
        named.unionByName(empty)
        .groupBy("brand_name")
        .agg(money_total(F.col("spent")).alias("total_spent"))
        .orderBy(F.col("total_spent").desc_nulls_first(), F.col("brand_name").asc_nulls_last())
    )


def new_user_brand_transactions(tables: Tables, months: int = 6) -> DataFrame:
    """Transactions and spend per brand among users created in the past months."""
    receipts = _new_user_receipts(tables, months)
    items = tables.items.select("receipt_id", "barcode", "final_price")
    per_receipt = (
        receipts.join(items, "receipt_id")
        .groupBy("receipt_id", "barcode")
        .agg(money_parts(F.col("final_price")).alias("spent"))
    )
    named = left_join_missing_keys(per_receipt, _brand_names(tables), "barcode", "receipt_id")
    empty = without_match(receipts, items, "receipt_id").select(
        "receipt_id",
        _no_brand(),
        F.lit(None).cast(named.schema["spent"].dataType).alias("spent"),
    )
    return (
        named.select("receipt_id", "brand_name", "spent")
        .unionByName(empty)
        .groupBy("brand_name")
        .agg(
            F.count_distinct("receipt_id").alias("total_transactions"),
            money_total(F.col("spent")).alias("total_spent"),
        )
        .orderBy(
            F.col("total_transactions").desc_nulls_first(),
            F.col("total_spent").desc_nulls_first(),
            F.col("brand_name").asc_nulls_last(),
        )
    )


def new_user_top_brand(tables: Tables, months: int = 6) -> DataFrame:
    """The known brand with most transactions; among equals, spend decides."""
    known = new_user_brand_transactions(tables, months).filter("brand_name IS NOT NULL")
    return leaders(known, "total_transactions", "total_spent")


def new_user_top_spend(tables: Tables, months: int = 6) -> DataFrame:
    """The known brand with most spend."""
    known = new_user_brand_spend(tables, months).filter("brand_name IS NOT NULL")
    return leaders(known, "total_spent")


def daily_brand_receipts(tables: Tables) -> DataFrame:
    """Receipts per day and brand, as a table to build reports on.

    A receipt with two brands counts under both, so days may be added up, brands may not.

    All receipts are asked for, so brands are looked up first, by items that have a barcode. Then items
    travel to their receipts once, and a receipt's brands are made distinct where they meet.
    """
    items = tables.items.select("receipt_id", "barcode")
    known, missing = split_missing_keys(items, "barcode")
    named = known.join(_brand_names(tables), "barcode", "left").select("receipt_id", "brand_name")
    named = named.unionByName(missing.select("receipt_id", _no_brand()))
    dated = tables.receipts.select("receipt_id", F.to_date("date_scanned").alias("day"))
    # Both joins have the same left side, which is shuffled once; receipts without an id match nothing.
    known, missing = split_missing_keys(dated, "receipt_id")
    bought = known.join(named, "receipt_id").distinct()
    empty = without_match(known, items, "receipt_id").unionByName(missing).select("receipt_id", "day", _no_brand()).distinct()
    # A receipt is in one of the two, once for each day and brand; ids that are missing don't count.
    return bought.unionByName(empty).groupBy("day", "brand_name").agg(F.count("receipt_id").alias("distinct_receipts"))
