"""Month windows that count back from the newest timestamp of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_window(df: DataFrame, ts: str, back_from: int, back_to: int = 0) -> DataFrame:
    """One row ``lo, hi``: whole months, from ``back_from`` months ago up to (not
    including) the month ``back_to`` months ago, taking ``max(ts)`` as today.

    The bounds carry the column's own type. A bound of another type would wrap the
    column in a cast, and the range would no longer reach the parquet scan.
    """
    kind = df.schema[ts].dataType
    today = df.agg(F.max(ts).alias("today"))

    def month_start(back: int) -> Column:
        shifted = F.col("today") - F.make_ym_interval(F.lit(0), F.lit(back))
        return F.trunc(shifted.cast("date"), "month").cast(kind)

    return today.select(month_start(back_from).alias("lo"), month_start(back_to).alias("hi"))


def in_window(column: str, window: DataFrame) -> Column:
    """``lo <= column < hi``, with the bounds as scalar subqueries (nothing is collected)."""
    value = F.col(column)
    return (value >= window.select("lo").scalar()) & (value < window.select("hi").scalar())
