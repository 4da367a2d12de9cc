"""The four tables as views of the given test tables, with data-quality faults planted.

Every view reads its whole test tables; faults come from attribute values. The text is
SQL that Spark and DuckDB both run, so both engines start from the same rows. ``{ts}`` is
the engine's name for a timestamp without zone.

Planted: barcodes missing on even line numbers, receipts without items, statuses without
amounts or counts, no ACCEPTED status, users stored twice (MACHINERY), receipts of unknown
users (FURNITURE), users without receipts (suppliers), barcodes of two brands (size 7),
brands that no item names (LARGE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.plans.tables import Tables

RECEIPTS = """
SELECT CAST(o_orderkey AS string) AS receipt_id,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 750 AS int) END AS bonus_points_earned,
       CASE WHEN o_orderstatus = 'F' THEN 'priority ' || o_orderpriority END AS bonus_points_earned_reason,
       CAST(o_orderdate AS {ts}) AS create_date,
       CAST(o_orderdate AS {ts}) AS date_scanned,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate + INTERVAL 1 DAY AS {ts}) END AS finished_date,
       CAST(o_orderdate + INTERVAL 2 HOUR AS {ts}) AS modify_date,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate + INTERVAL 1 DAY AS {ts}) END AS points_awarded_date,
       CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderkey % 1000 AS double) / 2 END AS points_earned,
       CAST(o_orderdate - INTERVAL 1 DAY AS {ts}) AS purchase_date,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 7 AS int) END AS purchased_item_count,
       CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'SUBMITTED' ELSE 'REJECTED' END
           AS rewards_receipt_status,
       CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS total_spent,
       CAST(o_custkey AS string) AS user_id
FROM {orders}
"""

ITEMS = """
SELECT CAST(l_orderkey AS string) AS receipt_id,
       CASE WHEN l_linenumber % 2 <> 0 THEN CAST(l_partkey AS string) END AS barcode,
       'part ' || CAST(l_partkey AS string) AS description,
       l_extendedprice AS final_price,
       l_extendedprice AS item_price,
       l_returnflag = 'R' AS needs_fetch_review,
       CAST(l_linenumber AS string) AS partner_item_id,
       l_linestatus = 'O' AS prevent_target_gap_points,
       CAST(l_quantity AS int) AS quantity_purchased,
       CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey AS string) END AS user_flagged_barcode,
       l_returnflag = 'N' AS user_flagged_new_item,
       l_discount AS user_flagged_price,
       l_linenumber AS user_flagged_quantity
FROM {lineitem}
"""

_CUSTOMER_USER = """
SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN 'G' ELSE '' END || CAST(c_custkey AS string) AS user_id,
       CAST(c_nationkey AS string) AS state,
       CAST(date '2001-07-31' - CAST(c_custkey % 730 AS int) AS {ts}) AS created_date,
       CASE WHEN c_acctbal >= 0 THEN CAST(date '2001-07-31' AS {ts}) END AS last_login,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN 'consumer' END AS role,
       c_acctbal >= 0 AS active,
       c_mktsegment AS sign_up_source
FROM {customer}
"""

USERS = f"""
{_CUSTOMER_USER}
UNION ALL
{_CUSTOMER_USER} WHERE c_mktsegment = 'MACHINERY'
UNION ALL
SELECT 'S' || CAST(s_suppkey AS string), CAST(s_nationkey AS string), CAST(NULL AS {{ts}}),
       CAST(NULL AS {{ts}}), 'staff', s_acctbal >= 0, 'SUPPLIER'
FROM {{supplier}}
"""

_PART_BARCODE = "CASE WHEN p_type = 'LARGE' THEN 'L' ELSE '' END || CAST(p_partkey AS string)"

BRANDS = f"""
SELECT 'P' || CAST(p_partkey AS string) AS brand_id,
       {_PART_BARCODE} AS barcode,
       upper(p_name) AS brand_code,
       p_type AS category,
       upper(p_type) AS category_code,
       'C' || CAST(p_size AS string) AS cpg_id,
       'Cogs' AS cpg_ref,
       p_retailprice > 1000 AS top_brand,
       p_brand AS name
FROM {{part}}
UNION ALL
SELECT 'D' || CAST(p_partkey AS string), {_PART_BARCODE}, upper(p_name), p_type, upper(p_type),
       'C' || CAST(p_size AS string), 'Cogs', p_retailprice > 1000, 'Alt ' || p_brand
FROM {{part}} WHERE p_size = 7
"""

SOURCES = ("orders", "lineitem", "customer", "supplier", "part")
VIEWS = {"receipts": RECEIPTS, "items": ITEMS, "users": USERS, "brands": BRANDS}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The four fixture tables over the parquet files of one scale factor."""
    given = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in SOURCES}

    def view(text: str) -> DataFrame:
        used = {name: df for name, df in given.items() if f"{{{name}}}" in text}
        return spark.sql(text.replace("{ts}", "timestamp_ntz"), **used)

    return Tables(**{name: view(text) for name, text in VIEWS.items()})


def duckdb_views() -> str:
    """The same tables as common table expressions, with the two cleaned ones."""
    names = {name: name for name in SOURCES} | {"ts": "timestamp"}
    views = [f"{name} AS ({text.format(**names)})" for name, text in VIEWS.items()]
    views += [
        "users_dedup AS (SELECT DISTINCT * FROM users)",
        "brands_cleaned AS (SELECT * FROM brands WHERE barcode NOT IN "
        "(SELECT barcode FROM brands GROUP BY barcode HAVING count(*) > 1))",
    ]
    return "WITH " + ", ".join(views)


def _object_id(column: str):
    return F.struct(F.col(column).alias("$oid"))


def _millis(column: str):
    """An epoch-milliseconds object; no object at all for NULL."""
    millis = F.unix_millis(F.col(column).cast("timestamp"))
    return F.when(millis.isNotNull(), F.struct(millis.alias("$date")))


def receipt_documents(receipts: DataFrame) -> DataFrame:
    """One JSON document per receipt; amounts as text, NULL as missing key."""
    document = F.struct(
        _object_id("receipt_id").alias("_id"),
        F.col("bonus_points_earned").alias("bonusPointsEarned"),
        F.col("bonus_points_earned_reason").alias("bonusPointsEarnedReason"),
        _millis("create_date").alias("createDate"),
        _millis("date_scanned").alias("dateScanned"),
        _millis("finished_date").alias("finishedDate"),
        _millis("modify_date").alias("modifyDate"),
        _millis("points_awarded_date").alias("pointsAwardedDate"),
        F.col("points_earned").cast("string").alias("pointsEarned"),
        _millis("purchase_date").alias("purchaseDate"),
        F.col("purchased_item_count").alias("purchasedItemCount"),
        F.col("rewards_receipt_status").alias("rewardsReceiptStatus"),
        F.col("total_spent").cast("string").alias("totalSpent"),
        F.col("user_id").alias("userId"),
    )
    return receipts.select(F.to_json(document).alias("value"))


def item_documents(items: DataFrame) -> DataFrame:
    """One receipt document per item, with a list of two: the item, and one whose keys are
    all missing but for its ids."""
    full = F.struct(
        F.col("barcode"),
        F.col("description"),
        F.col("final_price").cast("string").alias("finalPrice"),
        F.col("item_price").cast("string").alias("itemPrice"),
        F.col("needs_fetch_review").alias("needsFetchReview"),
        F.col("partner_item_id").alias("partnerItemId"),
        F.col("prevent_target_gap_points").alias("preventTargetGapPoints"),
        F.col("quantity_purchased").alias("quantityPurchased"),
        F.col("user_flagged_barcode").alias("userFlaggedBarcode"),
        F.col("user_flagged_new_item").alias("userFlaggedNewItem"),
        F.col("user_flagged_price").cast("string").alias("userFlaggedPrice"),
        F.col("user_flagged_quantity").alias("userFlaggedQuantity"),
    )
    bare = F.struct(F.col("barcode"), F.concat("partner_item_id", F.lit("x")).alias("partnerItemId"))
    entries = F.concat(
        F.lit('{"_id":'), F.to_json(_object_id("receipt_id")),
        F.lit(',"rewardsReceiptItemList":['), F.to_json(full), F.lit(","), F.to_json(bare),
        F.lit("]}"),
    )
    return items.select(entries.alias("value"))


def user_documents(users: DataFrame) -> DataFrame:
    """One document per user. A NULL role is an explicit null for active users and a missing
    key for the others."""
    document = F.struct(
        _object_id("user_id").alias("_id"),
        "state",
        _millis("created_date").alias("createdDate"),
        _millis("last_login").alias("lastLogin"),
        "role",
        "active",
        F.col("sign_up_source").alias("signUpSource"),
    )
    keep_nulls = F.to_json(document, {"ignoreNullFields": "false"})
    text = F.when(F.col("active"), keep_nulls).otherwise(F.to_json(document))
    return users.select(text.alias("value"))


def brand_documents(brands: DataFrame) -> DataFrame:
    """One document per brand; top brands carry the flag, the others leave it out."""
    document = F.struct(
        _object_id("brand_id").alias("_id"),
        "barcode",
        F.col("brand_code").alias("brandCode"),
        "category",
        F.col("category_code").alias("categoryCode"),
        F.struct(_object_id("cpg_id").alias("$id"), F.col("cpg_ref").alias("$ref")).alias("cpg"),
        F.when(F.col("top_brand"), F.col("top_brand")).alias("topBrand"),
        "name",
    )
    return brands.select(F.to_json(document).alias("value"))
