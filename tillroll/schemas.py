"""The four target tables: source field, column, type, default and length limit.

Everything in this module is a fixed value: source field names, column names and
their order, types, defaults and limits are given by the data and the tables it
is loaded into.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """One column of a target table and where it comes from in the document.

    ``path`` lists the keys from the document's root down. ``kind`` is one of text,
    number, whole, flag, date.
    ``default`` stands in for a key that is missing (not for an explicit null).
    ``null_ok`` says whether an explicit null is stored or rejects the row.
    ``limit`` is the longest text the column holds.
    """

    column: str
    path: tuple[str, ...]
    kind: str
    default: object = None
    null_ok: bool = True
    limit: int | None = None


# fixed values: receipts, 14 columns
RECEIPT_FIELDS = (
    Field("receipt_id", ("_id", "$oid"), "text", null_ok=False, limit=24),
    Field("bonus_points_earned", ("bonusPointsEarned",), "whole"),
    Field("bonus_points_earned_reason", ("bonusPointsEarnedReason",), "text"),
    Field("create_date", ("createDate", "$date"), "date"),
    Field("date_scanned", ("dateScanned", "$date"), "date"),
    Field("finished_date", ("finishedDate", "$date"), "date"),
    Field("modify_date", ("modifyDate", "$date"), "date"),
    Field("points_awarded_date", ("pointsAwardedDate", "$date"), "date"),
    Field("points_earned", ("pointsEarned",), "number"),
    Field("purchase_date", ("purchaseDate", "$date"), "date"),
    Field("purchased_item_count", ("purchasedItemCount",), "whole"),
    Field("rewards_receipt_status", ("rewardsReceiptStatus",), "text", limit=50),
    Field("total_spent", ("totalSpent",), "number"),
    Field("user_id", ("userId",), "text", limit=24),
)

# fixed values: the item list of a receipt document, and the items' 12 own columns
# (the 13th, receipt_id, is carried down from the document)
ITEM_LIST = ("rewardsReceiptItemList",)
ITEM_FIELDS = (
    Field("barcode", ("barcode",), "text", limit=50),
    Field("description", ("description",), "text"),
    Field("final_price", ("finalPrice",), "number", default=0.0, null_ok=False),
    Field("item_price", ("itemPrice",), "number", default=0.0, null_ok=False),
    Field("needs_fetch_review", ("needsFetchReview",), "flag", default=False),
    Field("partner_item_id", ("partnerItemId",), "text", limit=50),
    Field("prevent_target_gap_points", ("preventTargetGapPoints",), "flag", default=False),
    Field("quantity_purchased", ("quantityPurchased",), "whole", default=0),
    Field("user_flagged_barcode", ("userFlaggedBarcode",), "text", limit=50),
    Field("user_flagged_new_item", ("userFlaggedNewItem",), "flag", default=False),
    Field("user_flagged_price", ("userFlaggedPrice",), "number", default=0.0, null_ok=False),
    Field("user_flagged_quantity", ("userFlaggedQuantity",), "whole", default=0),
)

# fixed values: users, 7 columns
USER_FIELDS = (
    Field("user_id", ("_id", "$oid"), "text", null_ok=False, limit=24),
    Field("state", ("state",), "text", limit=2),
    Field("created_date", ("createdDate", "$date"), "date"),
    Field("last_login", ("lastLogin", "$date"), "date"),
    Field("role", ("role",), "text", default="CONSUMER", limit=20),
    Field("active", ("active",), "flag", default=True),
    Field("sign_up_source", ("signUpSource",), "text", limit=50),
)

# fixed values: brands, 9 columns
BRAND_FIELDS = (
    Field("brand_id", ("_id", "$oid"), "text", null_ok=False, limit=24),
    Field("barcode", ("barcode",), "text", limit=50),
    Field("brand_code", ("brandCode",), "text", limit=50),
    Field("category", ("category",), "text", limit=50),
    Field("category_code", ("categoryCode",), "text", limit=50),
    Field("cpg_id", ("cpg", "$id", "$oid"), "text", limit=24),
    Field("cpg_ref", ("cpg", "$ref"), "text", limit=20),
    Field("top_brand", ("topBrand",), "flag", default=False),
    Field("name", ("name",), "text"),
)

_TYPES = {
    "text": T.StringType(),
    "number": T.DoubleType(),
    "whole": T.IntegerType(),
    "flag": T.BooleanType(),
    "date": T.TimestampType(),
}


def _struct(fields: tuple[Field, ...]) -> T.StructType:
    return T.StructType([T.StructField(f.column, _TYPES[f.kind]) for f in fields])


RECEIPTS = _struct(RECEIPT_FIELDS)
ITEMS = T.StructType(
    [T.StructField("receipt_id", T.StringType()), *_struct(ITEM_FIELDS).fields]
)
USERS = _struct(USER_FIELDS)
BRANDS = _struct(BRAND_FIELDS)

# fixed values: load order, primary keys and length limits
TABLES = {"receipts": RECEIPTS, "items": ITEMS, "users": USERS, "brands": BRANDS}
PRIMARY_KEYS = {"receipts": "receipt_id", "brands": "brand_id"}
LIMITS = {
    "receipts": {f.column: f.limit for f in RECEIPT_FIELDS if f.limit},
    "items": {"receipt_id": 24} | {f.column: f.limit for f in ITEM_FIELDS if f.limit},
    "users": {f.column: f.limit for f in USER_FIELDS if f.limit},
    "brands": {f.column: f.limit for f in BRAND_FIELDS if f.limit},
}
