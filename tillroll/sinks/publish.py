"""All-or-nothing publishing of a batch of tables to a shared file system.

Layout below one root folder::

    data/<table>/batch=<id>/attempt=<uuid>/verdict=accepted|rejected/...   rows of an attempt
    keys/<table>/attempt=<uuid>/bucket=<n>/...    published keys, each in the bucket of its hash
    manifest/<number>.json                        one for each attempt that was published

Every call writes to folders of its own, checks them, and only then creates the manifest with
the next number. Readers follow the newest attempt of each batch. So a call that fails on the
way is invisible and leaves what readers see as it was, and a batch that is published again
under its id is replaced, not added a second time. Data that a manifest names is never touched.

Of two calls that run at the same time one creates the number first. The other is refused
(``ConcurrentPublish``), as it was checked against a state that is no longer the newest.

What a call reads does not grow with the batches before it: manifests since the last complete
one (every ``COMPLETE``-th lists all batches), and the key buckets that its own keys fall into.
A call rewrites these buckets, so that a bucket is one file; keys of attempts that no manifest
names don't count.
"""

from __future__ import annotations

import contextlib
import json
import logging
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillroll import schemas
from tillroll.operators.checks import key_violations, too_long
from tillroll.operators.flatten import REASON, SOURCE
from tillroll.operators.joins import with_match, without_match
from tillroll.sinks.files import create_once, names, remove
from tillroll.sources.pruning import in_partitions

log = logging.getLogger(__name__)

ACCEPTED, REJECTED = "accepted", "rejected"
MANIFEST = "batch string, number bigint, attempt string, table_name string, accepted_rows bigint, rejected_rows bigint"


KEYS = "key string, batch string, row_attempt string"
#: Buckets of a table's published keys; to be chosen before the first batch, for a bucket of some 100,000 keys.
BUCKETS = 64
#: Every so many manifests there is one that lists all batches.
COMPLETE = 32


class ConstraintViolation(ValueError):
    """A batch that must not be published, with the tables and rules it breaks."""


class ConcurrentPublish(RuntimeError):
    """Another batch was published meanwhile: publish again."""


@contextlib.contextmanager
def _two_files_at_once(spark: SparkSession) -> Iterator[None]:
    """A task that writes to two folders keeps both files open instead of sorting its rows."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _write_rows(rows: DataFrame, path: str) -> tuple[int, int]:
    """Write accepted and rejected rows in one pass and count both on the way."""
    good = F.col(REASON).isNull()
    seen = Observation()
    counted = rows.withColumn("verdict", F.when(good, ACCEPTED).otherwise(REJECTED)).observe(
        seen,
        F.count_if(good).alias(ACCEPTED),
        F.count_if(~good).alias(REJECTED),
    )
    with _two_files_at_once(rows.sparkSession):
        counted.write.partitionBy("verdict").parquet(path)
    return seen.get[ACCEPTED], seen.get[REJECTED]


def tag_plain(df: DataFrame) -> DataFrame:
    """Give rows that need no flattening the reject columns the writer expects."""
    nothing = F.lit(None).cast("string")
    return df.withColumns({REASON: nothing, SOURCE: nothing})


def _manifest_files(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    """The newest number, and the manifests to read: those since the last complete one."""
    found = [n for n in names(spark, f"{root}/manifest") if n.endswith(".json")]
    complete = max((i for i, n in enumerate(found) if n.endswith(".all.json")), default=0)
    number = int(found[-1].split(".")[0]) if found else 0
    return number, [f"{root}/manifest/{n}" for n in found[complete:]]


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per table of the newest published attempt of each batch."""
    _, paths = _manifest_files(spark, root)
    if not paths:
        return spark.createDataFrame([], MANIFEST)
    files = spark.read.schema(MANIFEST).json(paths)
    newest = files.groupBy("batch").agg(F.max(F.struct("number", "attempt")).alias("newest"))
    newest = newest.select("batch", F.col("newest.attempt").alias("attempt"))
    return files.join(newest, ["batch", "attempt"]).select(files.columns)


def _stored(spark: SparkSession, root: str, table: str, schema, verdict: str, but: str | None) -> DataFrame:
    """Rows of a verdict in the published attempts, read from the folders that manifests name."""
    listed = manifests(spark, root).filter((F.col("table_name") == table) & (F.col(f"{verdict}_rows") > 0))
    # One row for each batch.
    paths = [
        f"{root}/data/{table}/batch={r['batch']}/attempt={r['attempt']}/verdict={verdict}"
        for r in listed.select("batch", "attempt").collect()
        if r["batch"] != but
    ]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_published(spark: SparkSession, root: str, table: str, but: str | None = None) -> DataFrame:
    """All accepted rows of a table's published batches, without those of the batch ``but``."""
    return _stored(spark, root, table, schemas.TABLES[table], ACCEPTED, but)


def read_rejected(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Reason and source of all rejected rows of a table's published batches."""
    schema = StructType([StructField(c, StringType()) for c in (REASON, SOURCE)])
    return _stored(spark, root, table, schema, REJECTED, None)


def _bucketed(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("key")).filter("key IS NOT NULL").withColumn("bucket", F.pmod(F.hash("key"), F.lit(BUCKETS)))


def _index(spark: SparkSession, root: str, table: str, keys: DataFrame) -> DataFrame | None:
    """Published keys in the buckets of the given ones: key, batch, row_attempt, bucket."""
    path = f"{root}/keys/{table}"
    if not names(spark, path):
        return None
    stored = spark.read.schema(f"{KEYS}, attempt string, bucket int").parquet(path)
    valid = manifests(spark, root).select("batch", F.col("attempt").alias("row_attempt")).distinct()
    near = in_partitions(stored, "bucket", keys.select("bucket"))
    return near.join(valid, ["batch", "row_attempt"], "left_semi").select("key", "batch", "row_attempt", "bucket").distinct()


def published_keys(spark: SparkSession, root: str, table: str, rows: DataFrame, but: str | None = None) -> DataFrame:
    """Which keys of some rows are published already, by batches other than ``but``.

    Reads the buckets of the index that these keys fall into, and no data.
    """
    key = schemas.PRIMARY_KEYS[table]
    keys = _bucketed(rows, key)
    near = _index(spark, root, table, keys)
    if near is None:
        return keys.filter("false").select(F.col("key").alias(key))
    if but is not None:
        near = near.filter(F.col("batch") != but)
    return with_match(near.select("key"), keys, "key").select(F.col("key").alias(key)).distinct()


def _write_keys(spark: SparkSession, root: str, table: str, batch: str, attempt: str, rows: DataFrame) -> list[str]:
    """Rewrite the buckets of a batch's keys into a folder of its own; returns what that makes obsolete."""
    path = f"{root}/keys/{table}"
    before = names(spark, path)
    keys = _bucketed(rows, schemas.PRIMARY_KEYS[table])
    near = _index(spark, root, table, keys)
    now = keys.select("key", F.lit(batch).alias("batch"), F.lit(attempt).alias("row_attempt"), "bucket")
    if near is not None:
        now = now.unionByName(near.filter(F.col("batch") != batch))
    now.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/attempt={attempt}")
    buckets = [n for n in names(spark, f"{path}/attempt={attempt}") if n.startswith("bucket=")]
    return [f"{path}/{old}/{b}" for old in before for b in buckets]


def broken_rules(table: str, rows: DataFrame, published: DataFrame | None) -> list[str]:
    """Rules that the new rows of a table break, by themselves or with the published keys among them.

    Each check stops at the first offending row.
    """
    broken = []
    if not too_long(rows, schemas.LIMITS[table]).isEmpty():
        broken.append(f"{table}: text longer than its column")
    key = schemas.PRIMARY_KEYS.get(table)
    if key:
        if not key_violations(rows, key).isEmpty():
            broken.append(f"{table}: {key} is missing or not unique")
        if published is not None and not published.isEmpty():
            broken.append(f"{table}: {key} is already published")
    return broken


def _manifest_text(rows: list[tuple]) -> str:
    columns = [part.split()[0] for part in MANIFEST.split(", ")]
    return "".join(json.dumps(dict(zip(columns, row, strict=True))) + "\n" for row in rows)


def publish(spark: SparkSession, root: str, batch: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Publish flattened tables together or not at all; returns the manifest.

    ``tables`` maps table names to the output of the flattening functions (or of
    ``tag_plain``). Tables without accepted rows are listed as empty and a warning is logged.
    A refused attempt leaves no files.
    """
    number = _manifest_files(spark, root)[0] + 1
    attempt, listed, broken, obsolete, own = uuid.uuid4().hex, [], [], [], []
    try:
        for name in (t for t in schemas.TABLES if t in tables):
            path = f"{root}/data/{name}/batch={batch}/attempt={attempt}"
            own.append(path)
            good, bad = _write_rows(tables[name], path)
            if good:
                rows = spark.read.schema(schemas.TABLES[name]).parquet(f"{path}/verdict={ACCEPTED}")
                keyed = name in schemas.PRIMARY_KEYS
                broken += broken_rules(name, rows, published_keys(spark, root, name, rows, but=batch) if keyed else None)
                if keyed and not broken:
                    own.append(f"{root}/keys/{name}/attempt={attempt}")
                    obsolete += _write_keys(spark, root, name, batch, attempt, rows)
                log.info("%s: %d rows, %d rejected", name, good, bad)
            else:
                log.warning("%s: no rows to publish, %d rejected", name, bad)
            listed.append((batch, number, attempt, name, good, bad))
        if broken:
            raise ConstraintViolation("; ".join(broken))
        everything, kind = listed, "json"
        if number % COMPLETE == 0:
            # All batches' newest attempts: a row for each batch and table.
            others = manifests(spark, root).filter(F.col("batch") != batch).collect()
            everything, kind = [*map(tuple, others), *listed], "all.json"
        if not create_once(spark, f"{root}/manifest/{number:012}.{kind}", _manifest_text(everything)):
            raise ConcurrentPublish(f"{batch}: another batch was published as number {number}")
    except BaseException:
        for path in own:
            remove(spark, path)
        raise
    for path in obsolete:
        remove(spark, path)
    for path in sorted({p.rsplit("/", 1)[0] for p in obsolete}):
        if not any(n.startswith("bucket=") for n in names(spark, path)):
            remove(spark, path)
    return spark.createDataFrame(listed, MANIFEST)


def unpublished(new: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Rows of an export that are not published yet: only these need to be loaded.

    Of the published keys only those among the new ones are kept and deduplicated.
    """
    return without_match(new, with_match(published.select(key), new, key), key)
