"""Cleaned tables that follow their source batch by batch.

A cleaned table is stored in hash partitions of its key. What a batch changes can only be in the
partitions of its own keys, so a refresh reads and replaces these and leaves the others' files as
they are. It also tells what changed, retractions included: a second brand with a barcode that
is stored takes the first one out of the cleaned brands.

Layout below a root: source rows by batch (see ``sinks/attempts.py``), within a batch by bucket;
``clean/bucket=<n>/`` with the cleaned rows; ``changes/batch=<id>/`` with the last change set of a batch.

A batch that is applied again replaces its rows, and one that failed on the way can simply be
applied again: what it changes follows from the batches that are in place, not from how far it got.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.operators.keys import dedup_rows, rows_by_key, unambiguous
from tillroll.sinks import attempts
from tillroll.sinks.files import names, remove


@dataclass(frozen=True)
class Cleaned:
    """A cleaned table: its source's name and key, what is kept of the rows of one hash
    partition, and what readers see of that."""

    source: str
    key: str
    keep: Callable[[DataFrame], DataFrame]
    show: Callable[[DataFrame], DataFrame]
    buckets: int = 64


USERS_DEDUP = Cleaned("users", "user_id", dedup_rows, lambda kept: kept)
BRANDS_CLEANED = Cleaned("brands", "barcode", lambda df: rows_by_key(df, "barcode"), lambda kept: unambiguous(kept, "barcode"))


def _schema(table: Cleaned, kind: str = "timestamp"):
    """The source's columns; ``kind`` is the type of its timestamps."""
    return ", ".join(f"{f.name} {kind if f.dataType.typeName() == 'timestamp' else f.dataType.simpleString()}" for f in schemas.TABLES[table.source])


def _source(spark: SparkSession, root: str, valid: dict[str, str], buckets: list[str], schema: str) -> DataFrame:
    """Rows of some attempts in some buckets, with the bucket."""
    paths = []
    for batch, attempt in valid.items():
        path = attempts.folder(root, batch, attempt)
        paths += [f"{path}/{b}" for b in names(spark, path) if b in buckets]
    if not paths:
        return spark.createDataFrame([], f"{schema}, bucket int")
    rows = spark.read.schema(schema).parquet(*paths)
    return rows.withColumn("bucket", F.regexp_extract(F.col("_metadata.file_path"), r"/bucket=(\d+)/", 1).cast("int"))


def _kept(table: Cleaned, rows: DataFrame) -> DataFrame:
    return table.keep(rows.drop("bucket")).withColumn("bucket", _bucket(table))


def _bucket(table: Cleaned):
    return F.pmod(F.hash(table.key), F.lit(table.buckets))


def apply_batch(spark: SparkSession, root: str, table: Cleaned, batch: str, rows: DataFrame) -> DataFrame:
    """Put a batch of source rows in place and bring the cleaned table up to date.

    Returns the change set: rows that the cleaned table gained (``change`` is ``added``) and lost
    (``removed``). It is about keys that are there; brands that a missing barcode hides are not in it.
    """
    kinds = {k for _, k in rows.dtypes if k.startswith("timestamp")}
    schema = _schema(table, next(iter(kinds), "timestamp"))
    columns = [f.name for f in schemas.TABLES[table.source]]
    valid, attempt = attempts.applied(spark, root), attempts.new_attempt(batch)
    path = attempts.folder(root, batch, attempt)
    # Gathered by bucket, so that a bucket is one file; rebalancing splits a large one.
    rows.select(*columns).withColumn("bucket", _bucket(table)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    old = [n for n in names(spark, attempts.folder(root, batch, valid[batch])) if n.startswith("bucket=")] if batch in valid else []
    touched = sorted({n for n in names(spark, path) if n.startswith("bucket=")} | set(old))
    before = _kept(table, _source(spark, root, valid, touched, schema))
    after = _kept(table, _source(spark, root, valid | {batch: attempt}, touched, schema))
    signed = after.withColumn("sign", F.lit(1)).unionByName(before.withColumn("sign", F.lit(-1)))
    changed = table.show(signed.filter("sign > 0").drop("sign", "bucket")).withColumn("sign", F.lit(1))
    changed = changed.unionByName(table.show(signed.filter("sign < 0").drop("sign", "bucket")).withColumn("sign", F.lit(-1)))
    changed = changed.groupBy(*columns).agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    change = F.when(F.col("sign") > 0, "added").otherwise("removed")
    log = f"{root}/changes/batch={batch}"
    changed.select(*columns, change.alias("change")).write.mode("overwrite").parquet(log)
    clean = after.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    clean.partitionBy("bucket").parquet(f"{root}/clean")
    # Buckets without rows any more: the replaced attempt had them, no other batch has.
    held = {n for b, a in (valid | {batch: attempt}).items() for n in names(spark, attempts.folder(root, b, a))} if old else set(touched)
    for gone in set(touched) - held:
        remove(spark, f"{root}/clean/{gone}")
    attempts.apply(spark, root, batch, attempt)
    return spark.read.schema(f"{schema}, change string").parquet(log)


def read_clean(spark: SparkSession, root: str, table: Cleaned) -> DataFrame:
    """The cleaned table as the batches in place make it."""
    stored = spark.read.parquet(f"{root}/clean")
    return table.show(stored.drop("bucket"))
