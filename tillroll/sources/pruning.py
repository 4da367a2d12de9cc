"""Reading only the partitions a question needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_partitions(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose partition is among the values of ``wanted``; the others' files are not read.

    The values become one array (a scalar subquery), which the scan knows before it chooses
    its files. Meant for partition columns: an array of days or hash buckets stays small.
    Where ``wanted`` is not deterministic (parsed text that is read again), all files are read.
    """
    return df.filter(F.array_contains(wanted.agg(F.collect_set(column)).scalar(), F.col(column)))


def on_days(column: str, days: list[str | None]) -> Column:
    """Whether a date is among the given ones (ISO texts); None stands for a missing date."""
    known = [F.lit(d).cast("date") for d in days if d is not None]
    among = F.col(column).isin(known) if known else F.lit(False)
    return among | F.col(column).isNull() if None in days else among
