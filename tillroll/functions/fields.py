"""Typed values and complaints for the fields of a semi-structured document.

A typed JSON reader cannot tell a missing key from an explicit null, nor a wrong type
from a null, so documents are VARIANTs. One cast takes all fields out of a document, as
variants: NULL is a missing key, a variant null a null. Plain text is read as it is; of what is
not plain, the field's JSON is looked at, which tells ``5``, a number, from ``"5"``, a text.
Fields are never looked up one by one: a path that leads nowhere is left by an exception.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numbers import (
    PLAIN_WHOLE,
    double_to_int,
    is_plain_decimal,
    nan_to_null,
    text_to_double,
    text_to_int,
)
from tillroll.schemas import Field

# The range of dates a calendar with four-digit years holds, in epoch milliseconds.
_FIRST_MILLI, _LAST_MILLI = -62_135_596_800_000, 253_402_300_799_999


def json_path(keys: tuple[str, ...]) -> str:
    return "$" + "".join(f'["{key}"]' for key in keys)


def leaf(document: Column, keys: tuple[str, ...]) -> Column:
    """The value below ``keys``; NULL when missing, a variant null when null."""
    return F.try_variant_get(document, json_path(keys), "variant")


def kind(document: Column, keys: tuple[str, ...]) -> Column:
    """Type of the value below ``keys``: VOID, STRING, BIGINT, ...; NULL when missing."""
    return F.schema_of_variant(leaf(document, keys))


def is_object(document: Column) -> Column:
    """Whether a variant is a JSON object (NULL-safe)."""
    return F.try_variant_get(document, "$", "struct<_id:variant>").isNotNull()


def shape(fields: tuple[Field, ...]) -> str:
    """The struct type that holds the fields of a document where the document has them."""
    tree: dict = {}
    for field in fields:
        *parents, last = field.path
        node = tree
        for key in parents:
            node = node.setdefault(key, {})
        node[last] = "variant"

    def ddl(node: dict | str) -> str:
        if isinstance(node, str):
            return node
        return "struct<" + ",".join(f"`{k}`:{ddl(v)}" for k, v in node.items()) + ">"

    return ddl(tree)


def computed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``df.select(columns)`` whose columns later filters cannot compute again.

    Catalyst pushes a filter on a computed column below the projection and repeats the
    computation for each use. It leaves a filter above a projection that is not
    deterministic, as the number of the task's partition makes it; the test on that number
    holds always and only keeps it from being pruned.
    """
    numbered = df.select(*columns, F.spark_partition_id().alias("_partition"))
    return numbered.filter("_partition >= 0").drop("_partition")


#: By kind: the text to look at first, which such texts are plain, and their value. Numbers are mostly texts, and
#: plain ones mean the same within quotes and without; of the others the JSON is looked at, as it is cheaper to write.
_QUICK = {
    "number": (lambda v: v.try_cast("string"), is_plain_decimal, lambda text: text.try_cast("double")),
    "whole": (F.to_json, lambda text: text.rlike("^-?[0-9]{1,9}$"), lambda text: text.try_cast("int")),
    "flag": (F.to_json, lambda text: (text == "true") | (text == "false"), lambda text: text == "true"),
    "date": (F.to_json, lambda text: text.rlike("^[0-9]{1,14}$"), lambda text: F.timestamp_millis(text.try_cast("bigint"))),
}


def taken(field: Field) -> Column:
    """A field's variant in ``taken``: NULL when missing, a variant null when null."""
    value = F.col("taken")
    for key in field.path:
        value = value.getField(key)
    return value


def take(document: Column, fields: tuple[Field, ...]) -> Column:
    """The fields' variants, NULL where the document is no object; to be named ``taken``."""
    return F.try_variant_get(document, "$", shape(fields))


def take_texts(df: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """Add ``texts`` to what was taken, by column name: a text, or what is plain of another kind; the
    JSON of what is not is ``odd_<column>``.

    Catalyst inlines a struct of which only fields are used, so that every use of a text would
    write it as JSON again; there are several for each field.
    """
    texts = []
    for field in fields:
        if field.kind == "text":
            texts.append(taken(field).try_cast("string").alias(field.column))
            continue
        first, plain, _ = _QUICK[field.kind]
        text = first(taken(field))
        texts.append(F.when(plain(text), text).alias(field.column))
        texts.append(F.when(~F.coalesce(plain(text), F.lit(False)), F.to_json(taken(field))).alias(f"odd_{field.column}"))
    return computed(df, *df.columns, F.struct(*texts).alias("texts"))


_QUOTE = '"'

# Spark computes an expression that is used twice ahead of both uses, even behind an AND.
# Only the later branches of a CASE are left alone until they are reached, so that is how
# the costly tests below are guarded.


def _text(text: Column, field: Field) -> tuple[Column, Column]:
    # Text that starts like an object or a list is one, or only looks like it.
    nested = F.schema_of_variant(taken(field)).rlike("^(?:OBJECT|ARRAY)")
    bracket = text.startswith("{") | text.startswith("[")
    return text, F.when(bracket, F.when(nested, F.lit("not a text")))


def _number(json: Column) -> tuple[Column, Column]:
    body = F.btrim(json, F.lit(_QUOTE))
    plain = is_plain_decimal(body)
    odd = nan_to_null(text_to_double(body))
    number = F.when(plain, body.try_cast("double")).otherwise(
        F.when(json == "true", 1.0).when(json == "false", 0.0).when(json != "null", odd)
    )
    good = plain | json.isin("true", "false", "null")
    bad = F.when(good, None).when(text_to_double(body).isNull(), F.lit("not a number"))
    return number, F.when(json.isNotNull(), bad)


def _whole(json: Column) -> tuple[Column, Column]:
    body = F.btrim(json, F.lit(_QUOTE))
    whole = F.when(text_to_int(body).isNotNull(), text_to_int(body)).when(
        ~json.startswith(_QUOTE), double_to_int(json.try_cast("double"))
    )
    # NaN stands for a missing value, not for a bad one.
    good = json.isNull() | json.isin("null", '"NaN"') | whole.isNotNull()
    return whole, F.when(~good, F.lit("not a whole number"))


def _flag(json: Column) -> tuple[Column, Column]:
    word = F.when(json.startswith(_QUOTE), F.btrim(json, F.lit(_QUOTE)).try_cast("boolean"))
    plain = json.isin("true", "false")
    flag = F.when(plain, json == "true").otherwise(word)
    bad = F.when(plain | (json == "null"), None).when(word.isNull(), F.lit("not true or false"))
    return flag, F.when(json.isNotNull(), bad)


def _date(json: Column) -> tuple[Column, Column]:
    whole, double = json.try_cast("bigint"), json.try_cast("double")

    def inside(millis: Column) -> Column:
        return millis.between(F.lit(_FIRST_MILLI), F.lit(_LAST_MILLI))

    stamp = F.when(json.rlike(PLAIN_WHOLE), F.when(inside(whole), F.timestamp_millis(whole))).when(
        ~json.startswith(_QUOTE),
        F.when(inside(double), F.timestamp_micros(F.round(double * 1000).cast("bigint"))),
    )
    # An explicit null is no date either.
    bad = json.isNotNull() & stamp.isNull()
    return stamp, F.when(bad, F.lit("not epoch milliseconds"))


_KINDS = {"number": _number, "whole": _whole, "flag": _flag, "date": _date}


def _read(kind_: str) -> Callable[[Column], Column]:
    def read(json: Column) -> Column:
        value, complaint = _KINDS[kind_](json)
        return F.struct(value.alias("value"), complaint.alias("complaint"))

    return read


def read_values(df: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """Add ``read_<kind>``: value and complaint of every field that is neither text nor plain, by kind.

    One function is applied to the list of a kind's odd texts, if there is one. Written out for each
    field, all of this would be one method of generated code, too large for the JVM to compile.
    """
    reads = []
    for kind_, of in _by_kind(fields).items():
        odd = [F.col("texts").getField(f"odd_{field.column}") for field in of]
        reads.append(F.when(F.coalesce(*odd).isNotNull(), F.transform(F.array(*odd), _read(kind_))).alias(f"read_{kind_}"))
    return df.select("*", *reads)


def _by_kind(fields: tuple[Field, ...]) -> dict[str, list[Field]]:
    return {k: of for k in _KINDS if (of := [field for field in fields if field.kind == k])}


def extract(field: Field, fields: tuple[Field, ...]) -> tuple[Column, Column]:
    """Value and complaint (NULL if the value can be stored) of one field of ``read_values``."""
    text = F.col("texts").getField(field.column)
    if field.kind == "text":
        found, complaint = _text(text, field)
    else:
        read = F.get(F.col(f"read_{field.kind}"), F.lit(_by_kind(fields)[field.kind].index(field)))
        found = F.when(text.isNotNull(), _QUICK[field.kind][2](text)).otherwise(read["value"])
        complaint = read["complaint"]
    if field.default is not None:
        found = F.when(taken(field).isNull(), F.lit(field.default)).otherwise(found)
    if not field.null_ok:
        complaint = F.when(F.is_variant_null(taken(field)), F.lit("null")).otherwise(complaint)
    if field.limit is not None:
        too_long = F.when(F.length(text) > field.limit, F.lit(f"longer than {field.limit}"))
        complaint = F.coalesce(complaint, too_long)
    return found.alias(field.column), F.concat(F.lit(f"{field.column}: "), complaint)
