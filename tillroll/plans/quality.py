"""Reports over all tables: the joined view, and the list of data-quality issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numbers import percent
from tillroll.operators.checks import domain_check
from tillroll.operators.joins import left_join_heavy_right, left_join_missing_keys, split_missing_keys, without_match
from tillroll.operators.keys import duplicate_excess
from tillroll.operators.linkage import linkage_summary
from tillroll.plans.tables import Tables


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))


def _without(df: DataFrame, missing: DataFrame) -> DataFrame:
    """Rows with NULL for the columns that only the other rows have."""
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in missing.schema if f.name not in df.columns))


def _whole_star(r: DataFrame, u: DataFrame, i: DataFrame, b: DataFrame) -> DataFrame:
    """The star of all receipts: users join the receipts and brands the items, before the two
    sides meet, so that a row travels with what it needs. Items without a barcode don't travel
    to the brands at all.
    """
    with_barcode, without = split_missing_keys(i, "i_barcode")
    named = with_barcode.join(b, "i_barcode", "left")
    items = named.unionByName(_without(without, named))
    with_users = left_join_missing_keys(r, u, "r_user_id", "r_receipt_id")
    # As in left_join_heavy_right; the items' keys are taken before brands are joined.
    matched = with_users.join(items, "r_receipt_id")
    return matched.unionByName(_without(without_match(with_users, i, "r_receipt_id"), matched))


def star_view(tables: Tables, receipts: DataFrame | None = None) -> DataFrame:
    """Receipts with their user, items and the items' brands, all left joined.

    Columns carry a prefix per table (``r_``, ``u_``, ``i_``, ``b_``), since the tables share
    names. Pass filtered ``receipts`` for the detail of a few.
    """
    r = _prefixed(tables.receipts if receipts is None else receipts, "r")
    u = _prefixed(tables.users_dedup, "u").withColumn("r_user_id", F.col("u_user_id"))
    i = _prefixed(tables.items, "i").withColumn("r_receipt_id", F.col("i_receipt_id"))
    b = _prefixed(tables.brands_cleaned, "b").withColumn("i_barcode", F.col("b_barcode"))
    if receipts is None:
        star = _whole_star(r, u, i, b)
    else:
        # Few receipts: items are joined first, so that only theirs are named.
        with_items = left_join_heavy_right(r, i, "r_receipt_id")
        with_users = left_join_missing_keys(with_items, u, "r_user_id", "r_receipt_id")
        star = left_join_missing_keys(with_users, b, "i_barcode", "r_receipt_id")
    return star.select(*r.columns, *(c for c in u.columns if c not in r.columns), *(c for c in i.columns if c not in r.columns), *(c for c in b.columns if c != "i_barcode"))


def receipt_detail(tables: Tables, receipt_id: Column) -> DataFrame:
    """The joined view of one receipt, where the tables are files in the order of their keys.

    The receipt's id selects receipts and items, its user's id users, each at the scan.
    """
    receipt = tables.receipts.filter(F.col("receipt_id") == receipt_id)
    user = receipt.agg(F.min("user_id")).scalar()
    near = Tables(receipt, tables.items.filter(F.col("receipt_id") == receipt_id), tables.users.filter(F.col("user_id") == user), tables.brands)
    return star_view(near)


def _issue(issue: str, table: str, affected: Column, of: Column, resolution: str) -> Column:
    return F.struct(
        F.lit(issue).alias("issue"),
        F.lit(table).alias("table_name"),
        affected.cast("bigint").alias("affected"),
        of.cast("bigint").alias("out_of"),
        percent(affected, of).alias("share_pct"),
        F.lit(resolution).alias("resolution"),
    )


def _issues(figures: DataFrame, *issues: Column) -> DataFrame:
    """Rows for the issues that one row of figures tells of."""
    return figures.select(F.inline(F.array(*issues)))


def issue_report(tables: Tables, required_status: str = "ACCEPTED") -> DataFrame:
    """One row per known kind of data-quality issue, with its extent and what to do.

    Figures that one aggregation gives are taken from it together.
    """
    col = F.col
    copies = duplicate_excess(tables.users, "user_id")
    per_barcode = tables.brands.groupBy("barcode").agg(F.count(F.lit(1)).alias("key_rows"))
    shared_by = col("barcode").isNotNull() & (col("key_rows") > 1)
    shared = per_barcode.agg(
        F.coalesce(F.sum(F.when(shared_by, col("key_rows"))), F.lit(0)).alias("shared_rows"),
        F.coalesce(F.sum("key_rows"), F.lit(0)).alias("brand_rows"),
    )
    items = linkage_summary(tables.receipts, tables.items, "receipt_id")
    users = linkage_summary(tables.receipts, tables.users_dedup, "user_id")
    brands = linkage_summary(tables.items, tables.brands_cleaned, "barcode")
    statuses = domain_check(tables.receipts, "rewards_receipt_status", [required_status])
    absent = statuses.agg(
        F.count_if(col("status") == "absent").alias("absent"), F.count_if("is_expected").alias("listed")
    )
    issues = [
        _issues(copies, _issue("duplicate rows", "users", col("excess_rows"), col("total_rows"),
               "join to the deduplicated users")),
        _issues(shared, _issue("barcode of several brands", "brands", col("shared_rows"), col("brand_rows"),
               "left out until the owner of the barcode is known")),
        _issues(items, _issue("receipts without items", "receipts", col("left_orphans"), col("left_keys"),
               "ask whether the scan was incomplete")),
        _issues(users, _issue("receipt users without user record", "receipts", col("left_orphans"),
               col("left_keys"), "ask for a full user export")),
        _issues(
            brands,
            _issue("item barcodes without brand", "items", col("left_orphans"),
                   col("left_keys"), "complete the brand catalogue"),
            _issue("brand barcodes without items", "brands", col("right_orphans"),
                   col("right_keys"), "check how barcodes are recorded"),
            _issue("items without barcode", "items", col("left_null_rows"), col("left_rows"),
                   "flag for review when loading"),
        ),
        _issues(absent, _issue(f"status {required_status} never used", "receipts", col("absent"),
               col("listed"), "ask for the list of statuses")),
    ]
    return reduce(DataFrame.unionByName, issues)
