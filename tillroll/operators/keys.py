"""Key uniqueness: profiles, duplicates, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.joins import with_match

Key = str | tuple[str, ...]


def _columns(key: Key) -> tuple[str, ...]:
    return (key,) if isinstance(key, str) else tuple(key)


def _rows() -> Column:
    return F.count(F.lit(1))


def key_profile(df: DataFrame, keys: list[Key]) -> DataFrame:
    """One row: ``total_rows`` and ``distinct_<key>`` for each candidate key.

    A tuple is a composite key. A key with a NULL part is not counted, and parts are never
    concatenated, so ("1", "23") and ("12", "3") stay different keys.

    Each key is counted over its own columns. Several distinct counts in one aggregation
    would send every row once for each of them.
    """
    distinct = [
        df.select(*_columns(key)).dropna().distinct().agg(_rows()).scalar().alias("distinct_" + "_".join(_columns(key)))
        for key in keys
    ]
    return df.agg(_rows().alias("total_rows")).select("total_rows", *distinct)


def duplicate_keys(df: DataFrame, key: Key) -> DataFrame:
    """Keys that occur more than once, with their number of rows. NULL counts as a key."""
    return df.groupBy(*_columns(key)).agg(_rows().alias("key_rows")).filter("key_rows > 1")


def duplicate_key_count(df: DataFrame, key: Key) -> DataFrame:
    return duplicate_keys(df, key).agg(_rows().alias("duplicate_keys"))


def duplicate_excess(df: DataFrame, key: Key) -> DataFrame:
    """Rows beyond the first of each key."""
    per_key = df.groupBy(*_columns(key)).agg(_rows().alias("key_rows"))
    total = F.coalesce(F.sum("key_rows"), F.lit(0).cast("bigint"))
    return per_key.agg(
        total.alias("total_rows"), _rows().alias("keys"), (total - _rows()).alias("excess_rows")
    )


def dedup_rows(df: DataFrame) -> DataFrame:
    """Drop rows that equal another row in every column."""
    return df.distinct()


def duplicates_are_exact(df: DataFrame, key: str) -> DataFrame:
    """Whether rows that share a key are copies of one another.

    They are when there are as many distinct rows as distinct keys.
    """
    profile = dedup_rows(df).agg(
        _rows().alias("distinct_rows"), F.count_distinct(key).alias("distinct_keys")
    )
    same = F.col("distinct_rows") == F.col("distinct_keys")
    return profile.withColumn("duplicates_are_exact", same)


def rows_with_duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """All rows of keys that occur more than once, next to each other.

    The sort goes on over the other columns: a range partitioner cannot split one key
    unless something behind it differs.
    """
    rows = with_match(df, duplicate_keys(df, key), key).select(*df.columns)
    rest = [c for c in df.columns if c != key]
    return rows.orderBy(*(F.col(c).asc_nulls_last() for c in (key, *rest)))


def rows_by_key(df: DataFrame, key: str) -> DataFrame:
    """For each key one of its rows (the least) and, as ``key_rows``, how many it has."""
    per_key = df.groupBy(F.col(key).alias("_key")).agg(_rows().alias("key_rows"), F.min(F.struct(*df.columns)).alias("_row"))
    return per_key.select("_row.*", "key_rows")


def unambiguous(by_key: DataFrame, key: str) -> DataFrame:
    """Of ``rows_by_key`` the rows that have their key alone, as ``key NOT IN (repeated keys)``.

    As with NOT IN, nothing is left when NULL is among the repeated keys, and a single NULL
    key stays only if no key is repeated; these two facts are one row.
    """
    repeated = by_key.filter("key_rows > 1")
    facts = repeated.agg(_rows().alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"))
    decided = (facts.select("nulls").scalar() == 0) & (F.col(key).isNotNull() | (facts.select("n").scalar() == 0))
    return by_key.filter((F.col("key_rows") == 1) & decided).drop("key_rows")


def drop_ambiguous_keys(df: DataFrame, key: str) -> DataFrame:
    """Drop every row of a key that occurs more than once, as ``key NOT IN`` would.

    A key that occurs once is its row, so one aggregation finds the rows. As with NOT IN,
    nothing is left when NULL is among the repeated keys, and a single NULL key stays only
    if no key is repeated; these two facts are read from the key column alone.
    """
    repeated = duplicate_keys(df, key)
    facts = repeated.agg(_rows().alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"))
    decided = (facts.select("nulls").scalar() == 0) & (F.col(key).isNotNull() | (facts.select("n").scalar() == 0))
    per_key = df.groupBy(key).agg(_rows().alias("_rows"), F.first(F.struct(*df.columns)).alias("_row"))
    return per_key.filter((F.col("_rows") == 1) & decided).select("_row.*")


class NotUniqueError(ValueError):
    """A cleaned table still has rows that share a key."""


def verify_unique(df: DataFrame, key: Key, name: str = "table") -> DataFrame:
    """Return the table unchanged, or raise when rows and distinct keys differ."""
    columns = _columns(key)
    profile = key_profile(df, [key]).first()
    if profile[0] != profile[1]:
        raise NotUniqueError(f"{name}: {profile[0]} rows, {profile[1]} distinct {', '.join(columns)}")
    return df


def daily_profile(df: DataFrame, ts: str, key: str) -> DataFrame:
    """Rows and distinct keys per calendar day."""
    return (
        df.groupBy(F.to_date(ts).alias("day"))
        .agg(_rows().alias("day_rows"), F.count_distinct(key).alias("distinct_keys"))
        .orderBy(F.col("day").asc_nulls_last())
    )
