"""Tables that are already there: lookup, scan and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def find_tables(spark: SparkSession, names: list[str], database: str | None = None) -> DataFrame:
    """Which of the named tables exist (metadata only)."""
    where = f" IN {database}" if database else ""
    shown = spark.sql(f"SHOW TABLES{where}")
    return shown.filter(F.col("tableName").isin(names)).select("namespace", "tableName")


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """Any ``rows`` rows; Spark reads only as many files as that takes."""
    return df.limit(rows)


def point_lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    """All rows whose column equals one value."""
    return df.filter(F.col(column) == value)
