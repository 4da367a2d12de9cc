"""Column checks: missing values, accepted values, lengths, unique keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numbers import percent
from tillroll.operators.keys import duplicate_keys


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, total_rows, null_rows, null_pct`` for each column, in one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *(F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)),
    )
    pairs = F.array(
        *(
            F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("null_rows"))
            for i, c in enumerate(columns)
        )
    )
    return counts.select("total_rows", F.inline(pairs)).select(
        "column_name",
        "total_rows",
        "null_rows",
        percent(F.col("null_rows"), F.col("total_rows")).alias("null_pct"),
    )


def domain_check(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """Every value found or expected, with its rows: ``ok``, ``unexpected`` or ``absent``."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    found = df.select(F.col(column).alias("value"), one.alias("found"), F.lit(False).alias("listed"))
    listed = df.sparkSession.createDataFrame([(v,) for v in expected], "value string").select(
        "value", none.alias("found"), F.lit(True).alias("listed")
    )
    counted = found.unionByName(listed).groupBy("value").agg(
        F.sum("found").alias("value_rows"), F.bool_or("listed").alias("is_expected")
    )
    status = (
        F.when(~F.col("is_expected"), "unexpected").when(F.col("value_rows") == 0, "absent")
    ).otherwise("ok")
    return counted.withColumn("status", status)


def too_long(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows with a text that is longer than its column, with the columns' names."""
    named = [F.when(F.length(c) > limit, F.lit(c)) for c, limit in limits.items()]
    return df.withColumn("too_long", F.concat_ws(", ", *named)).filter(F.col("too_long") != "")


def fits(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows whose texts all fit their columns."""
    inside = [F.col(c).isNull() | (F.length(c) <= limit) for c, limit in limits.items()]
    return df.filter(reduce(lambda a, b: a & b, inside))


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """What a primary key forbids: keys that are NULL or occur more than once."""
    nulls = df.filter(F.col(key).isNull()).groupBy(key).agg(F.count(F.lit(1)).alias("key_rows"))
    return duplicate_keys(df.filter(F.col(key).isNotNull()), key).unionByName(nulls)
