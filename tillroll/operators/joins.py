"""Joins whose plain form would not survive a hot or missing key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_missing_keys(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left outer join for a left side whose key is often NULL.

    A plain left join hashes all rows with a NULL key to one partition, though none of
    them can match. Here rows travel under the pair of the key and, where it is missing, a
    hash of ``spread_by``. Pairs are compared whole, so neither part can be decided before
    the shuffle; right rows without a key are left out, so a missing key equals none of
    theirs. Oversized partitions of a hot non-null key are split by AQE (a left outer join
    may split its left side).
    """
    columns = [c for c in right.columns if c != key]
    spread = F.when(F.col(key).isNull(), F.hash(spread_by))
    right = right.filter(F.col(key).isNotNull()).select(
        F.struct(F.col(key).alias("key"), F.lit(None).cast("int").alias("spread")).alias("_right_key"), *columns
    )
    travels = F.struct(F.col(key).alias("key"), spread.alias("spread"))
    return left.join(right, travels == F.col("_right_key"), "left").select(*left.columns, *columns)


def left_join_heavy_right(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left outer join for a right side that may have very many rows of one key.

    No engine may split the right side of a left outer join, so a hot key would end in one
    task. An inner join may be split on both sides, which leaves the left rows without a
    match: an anti join against the right side's keys, of which map-side aggregation leaves
    at most one per key and task.
    """
    added = [c for c in right.columns if c != key]
    matched = left.join(right, key).select(*left.columns, *added)
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in added]
    unmatched = without_match(left, right, key).select(*left.columns, *nothing)
    return matched.unionByName(unmatched)


def without_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows whose key is NULL or not among the right side's keys."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def with_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key IN (subquery)``: left rows whose key is among the right side's keys."""
    return left.join(right.select(key).distinct(), key, "left_semi")


def not_in(left: DataFrame, subquery: DataFrame, key: str) -> DataFrame:
    """``key NOT IN (subquery)`` with SQL's three-valued logic.

    Nothing qualifies when the subquery holds a NULL; a NULL key qualifies only when the
    subquery is empty. SQL's own NOT IN is planned as a broadcast of the subquery, whatever
    its size. An anti join plus one row of counts decides the same and shuffles if need be.
    The subquery's keys are distinct before they travel, so a hot one is a row per task.
    """
    keys = subquery.select(key)
    facts = keys.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")
    )
    decided = (facts.select("nulls").scalar() == 0) & (
        F.col(key).isNotNull() | (facts.select("n").scalar() == 0)
    )
    return left.filter(decided).join(keys.distinct(), key, "left_anti").select(*left.columns)


def split_missing_keys(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the key, and rows without it for review."""
    return df.filter(F.col(key).isNotNull()), df.filter(F.col(key).isNull())
