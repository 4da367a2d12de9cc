"""Ranks over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, group: str, measure: str, name: str) -> DataFrame:
    """SQL ``rank()`` of each row within its group, by a descending whole-number measure.

    A window over the rows would sort a whole group in one task. A row's rank is one more
    than the number of rows with a larger measure, so a histogram is enough: it has one row
    per distinct value, and d distinct counts can only come from at least d * (d + 1) / 2
    counted things (3 million values from 4.5 * 10^12). The window runs on the histogram.
    """
    histogram = df.groupBy(group, measure).agg(F.count(F.lit(1)).alias("_ties"))
    above = (
        Window.partitionBy(group)
        .orderBy(F.col(measure).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = histogram.select(
        group, measure, (F.coalesce(F.sum("_ties").over(above), F.lit(0)) + 1).alias(name)
    )
    return df.join(ranks, [group, measure])


def leaders(df: DataFrame, *measures: str) -> DataFrame:
    """The rows that are first by the measures, earlier ones deciding; ties all stay."""
    best = df.agg(F.max(F.struct(*measures)).alias("best"))
    return df.filter(F.struct(*measures) == best.scalar())


def top_k(df: DataFrame, k: int, measure: str, tie_break: str) -> DataFrame:
    """The ``k`` rows with the largest measure; equal ones in the tie-break's order."""
    return df.orderBy(F.col(measure).desc_nulls_first(), F.col(tie_break).asc_nulls_last()).limit(k)
