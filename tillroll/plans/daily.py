"""Receipts and items in folders by day of scan, and brand counts stored for each day.

A receipt has one day, so its counts belong to one day: days may be added up to a month. A batch
is written by day, an item under its receipt's day. A batch touches the days of its receipts and
those of the attempt it replaces; they are stale until the counts of just these days are
computed again and their folders replaced. Questions about a month add up stored days and count
only the stale ones from receipts and items.

Where a day has few rows, a folder may hold a month instead (``unit``); all of the above then
holds for months. ``since`` is the first day of a folder.

Layout below a root: ``rows/batch=<id>/attempt=<uuid>/table=receipts|items/since=<date>/`` (see
``sinks/attempts.py``), ``daily/since=<date>/``, and ``stale/`` with what each change touched.
A change is noted as stale before it counts, and the note removed after its folders were replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.calendar import in_window, month_window
from tillroll.operators.joins import with_match
from tillroll.operators.ranking import top_k
from tillroll.plans.marts import brand_counts, daily_brand_receipts
from tillroll.plans.tables import Tables
from tillroll.sinks import attempts
from tillroll.sinks.files import create_once, names, remove
from tillroll.sources.pruning import on_days

DAILY = "day date, brand_name string, distinct_receipts bigint, since date"
#: How Spark names the folder of rows without the partition's value.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class DayStore:
    """Where receipts, items and counts are, and what a folder holds: a ``day`` or a ``month``."""

    root: str
    unit: str = "day"

    def since(self, date: Column) -> Column:
        return F.trunc(date, "month") if self.unit == "month" else date


def _folders(spark: SparkSession, path: str) -> set[str]:
    return {n.split("=", 1)[1] for n in names(spark, path) if n.startswith("since=")}


def _by_day(df: DataFrame, then: str) -> DataFrame:
    """Rows dealt out by ranges of days: few files for a day, and tasks share a day with very many rows."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "since", then)


def _note_stale(spark: SparkSession, store: DayStore, days) -> None:
    if days:
        create_once(spark, f"{store.root}/stale/{uuid.uuid4().hex}", "".join(f"{d}\n" for d in sorted(days)))


def _stale(spark: SparkSession, store: DayStore) -> tuple[list[str], list[str | None]]:
    """The notes, and the days they name; a row for each calendar day at most."""
    notes = [f"{store.root}/stale/{n}" for n in names(spark, f"{store.root}/stale") if not n.startswith((".", "_"))]
    if not notes:
        return [], []
    days = [r["value"] for r in spark.read.text(notes).distinct().collect()]
    return notes, sorted((None if d == NO_DAY else d for d in days), key=lambda d: d or "")


def placed(store: DayStore, receipts: DataFrame, items: DataFrame, *carried: str) -> DataFrame:
    """Items with ``since`` of their receipt, and what else of it is carried; missing where there is no such receipt."""
    dated = receipts.select("receipt_id", store.since(F.to_date("date_scanned")).alias("since"), *carried)
    return items.join(dated, "receipt_id", "left")


def add_batch(spark: SparkSession, store: DayStore, batch: str, receipts: DataFrame, items: DataFrame) -> None:
    """Put a batch of receipts and their items in place, instead of an earlier attempt of it.

    Items of receipts that the batch does not hold have no day. Items that are ``placed`` already
    (whoever takes several batches out of one table does that once for all) keep their ``since``.
    """
    valid, attempt = attempts.applied(spark, store.root), attempts.new_attempt(batch)
    path = attempts.folder(store.root, batch, attempt)
    dated = receipts.withColumn("since", store.since(F.to_date("date_scanned")))
    _by_day(dated, "receipt_id").write.partitionBy("since").parquet(f"{path}/table=receipts")
    if "since" not in items.columns:
        items = placed(store, receipts, items)
    _by_day(items, "receipt_id").write.partitionBy("since").parquet(f"{path}/table=items")
    touched = _folders(spark, f"{path}/table=receipts")
    if batch in valid:
        touched |= _folders(spark, f"{attempts.folder(store.root, batch, valid[batch])}/table=receipts")
    _note_stale(spark, store, touched)
    attempts.apply(spark, store.root, batch, attempt)


def note_brand_changes(spark: SparkSession, store: DayStore, changes: DataFrame) -> None:
    """The days with items of brands that a change set of the cleaned brands adds or removes."""
    bought = with_match(stored(spark, store, "items").select("since", "barcode"), changes.filter("barcode IS NOT NULL"), "barcode")
    days = bought.select(F.coalesce(F.col("since").cast("string"), F.lit(NO_DAY)).alias("since")).distinct()
    _note_stale(spark, store, {r["since"] for r in days.collect()})


def stored(spark: SparkSession, store: DayStore, table: str) -> DataFrame:
    """Receipts or items of all batches in place, partitioned by ``since``."""
    paths = [f"{attempts.folder(store.root, batch, attempt)}/table={table}" for batch, attempt in attempts.applied(spark, store.root).items()]
    held = [p for p in paths if _folders(spark, p)]
    return spark.read.option("basePath", f"{store.root}/rows").parquet(*held).drop("batch", "attempt", "table")


def _on(spark: SparkSession, store: DayStore, brands: DataFrame, condition) -> Tables:
    receipts, items = (stored(spark, store, t).filter(condition) for t in ("receipts", "items"))
    return Tables(receipts, items, brands.limit(0), brands)  # no users are asked for


def refresh(spark: SparkSession, store: DayStore, brands: DataFrame) -> list[str | None]:
    """Count the stale days again and replace their folders; returns these days."""
    notes, days = _stale(spark, store)
    if days:
        counts = daily_brand_receipts(_on(spark, store, brands, on_days("since", days)))
        counts = counts.withColumn("since", store.since(F.col("day")))
        writer = _by_day(counts, "brand_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("since").parquet(f"{store.root}/daily")
        held = set().union(*(_folders(spark, f"{attempts.folder(store.root, b, a)}/table=receipts") for b, a in attempts.applied(spark, store.root).items()))
        for gone in {d or NO_DAY for d in days} - held:
            remove(spark, f"{store.root}/daily/since={gone}")
    for note in notes:
        remove(spark, note)
    return days


def _daily(spark: SparkSession, store: DayStore) -> DataFrame:
    if not _folders(spark, f"{store.root}/daily"):
        return spark.createDataFrame([], DAILY)
    return spark.read.schema(DAILY).parquet(f"{store.root}/daily")


def read_daily(spark: SparkSession, store: DayStore) -> DataFrame:
    """The stored counts: ``day, brand_name, distinct_receipts``."""
    return _daily(spark, store).drop("since")


def top_brands(spark: SparkSession, store: DayStore, brands: DataFrame, back: int = 1, k: int = 5) -> DataFrame:
    """Top brands of the month ``back`` months ago, from the stored days and, of the stale ones
    in that month, from receipts and items. Other days' items are not read."""
    month = in_window("since", month_window(stored(spark, store, "receipts"), "since", back, back - 1))
    _, days = _stale(spark, store)
    counts = _daily(spark, store).filter(month & ~on_days("since", days)).drop("since")
    if days:
        counts = counts.unionByName(daily_brand_receipts(_on(spark, store, brands, on_days("since", days) & month)))
    return top_k(counts.groupBy("brand_name").agg(F.sum("distinct_receipts").alias("distinct_receipts")), k, "distinct_receipts", "brand_name")


def top_brands_of_days(spark: SparkSession, store: DayStore, brands: DataFrame, back: int = 1, k: int = 5) -> DataFrame:
    """The same from receipts and items alone: the month's bounds, known once the query runs,
    choose the folders that are read of both."""
    month = in_window("since", month_window(stored(spark, store, "receipts"), "since", back, back - 1))
    of_month = _on(spark, store, brands, month)
    return top_k(brand_counts(of_month, of_month.receipts), k, "distinct_receipts", "brand_name")
