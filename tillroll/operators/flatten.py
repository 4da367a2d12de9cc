"""Nested documents to flat, typed rows.

Every function returns one row per candidate with the table's columns, a
``reject_reason`` that is NULL for rows that can be stored, and the ``source`` text of
those that cannot. ``accepted`` and ``rejected`` split the result; a writer can also
store both parts in one pass (see ``tillroll.sinks.publish``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.functions.fields import computed, extract, json_path, kind, read_values, shape, take, take_texts, taken

REASON, SOURCE = "reject_reason", "source"


# Every kind of document has its id there.
_ID = schemas.RECEIPT_FIELDS[0]


def _no_id() -> Column:
    return F.when(taken(_ID).isNull(), F.lit("document has no id"))


def _no_reference(document: Column) -> Column:
    """A reference may be missing; if it is there it has to be an object."""
    reference = kind(document, ("cpg",))
    return F.when(~reference.startswith("OBJECT"), F.lit("cpg: not an object"))


def _rows(
    rows: DataFrame,
    source: Column,
    fields: tuple[schemas.Field, ...],
    carried: tuple[str, ...] = (),
    complaints: tuple[Column, ...] = (),
) -> DataFrame:
    """Columns and complaints of all fields, whose variants are ``taken``, in one projection."""
    given = [c for c in rows.columns if c != "taken"]
    rows = read_values(take_texts(rows, fields), fields)
    extracted = [extract(field, fields) for field in fields]
    reasons = F.concat_ws("; ", *complaints, *(complaint for _, complaint in extracted))
    values = [value for value, _ in extracted]
    inputs = [c for c in given if c not in carried]
    rows = rows.select(*carried, *values, F.nullif(reasons, F.lit("")).alias(REASON), *inputs)
    # Only rejects need their source text.
    return rows.withColumn(SOURCE, F.when(F.col(REASON).isNotNull(), source)).drop(*inputs)


def _documents(documents: DataFrame, fields, *complaints) -> DataFrame:
    document = F.col("document")
    # A line that could not be read has no id either; one reason is enough.
    first = F.coalesce(F.col("line_error"), _no_id())
    checks = tuple(check(document) for check in complaints)
    documents = documents.select("*", take(document, fields).alias("taken"))
    return _rows(documents, F.col("line"), fields, complaints=(first, *checks))


def flatten_receipts(documents: DataFrame) -> DataFrame:
    return _documents(documents, schemas.RECEIPT_FIELDS)


def flatten_users(documents: DataFrame) -> DataFrame:
    return _documents(documents, schemas.USER_FIELDS)


def flatten_brands(documents: DataFrame) -> DataFrame:
    return _documents(documents, schemas.BRAND_FIELDS, _no_reference)


def flatten_items(documents: DataFrame) -> DataFrame:
    """One row per element of the receipts' item lists.

    Documents without an id, without a list, or with something else in its place give
    no rows. Items of a receipt that is itself rejected are kept: the linkage profile
    reports them as orphans.
    """
    document = F.col("document")

    def listed(element: str) -> Column:
        return F.try_variant_get(document, json_path(schemas.ITEM_LIST), f"array<{element}>")

    items = documents.select(
        F.try_variant_get(document, json_path(_ID.path), "string").alias("receipt_id"),
        "document",
        F.posexplode(listed(shape(schemas.ITEM_FIELDS))).alias("place", "taken"),
    ).filter(F.col("receipt_id").isNotNull())
    receipt_id = F.col("receipt_id")
    limit = schemas.LIMITS["items"]["receipt_id"]
    return _rows(
        items,
        # The element itself is only looked up for rejects.
        F.to_json(F.get(listed("variant"), F.col("place"))),
        schemas.ITEM_FIELDS,
        carried=("receipt_id",),
        complaints=(
            F.when(F.col("taken").isNull(), F.lit("item is not an object")),
            F.when(F.length(receipt_id) > limit, F.lit(f"receipt_id: longer than {limit}")),
        ),
    )


FLATTEN = {
    "receipts": flatten_receipts,
    "items": flatten_items,
    "users": flatten_users,
    "brands": flatten_brands,
}


def accepted(rows: DataFrame) -> DataFrame:
    """The rows that can be stored, with the table's columns only."""
    return computed(rows, *rows.columns).filter(F.col(REASON).isNull()).drop(REASON, SOURCE)


def rejected(rows: DataFrame) -> DataFrame:
    """The rows that cannot, each with its reason and its source text."""
    return computed(rows, REASON, SOURCE).filter(F.col(REASON).isNotNull())
