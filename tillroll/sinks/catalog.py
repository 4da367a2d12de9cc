"""Catalog tables: creating, appending, materialising, and their layout on disk."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.operators.linkage import key_counts
from tillroll.sinks.files import names, remove


def _columns(table: str) -> str:
    limits = schemas.LIMITS[table]
    return ", ".join(
        f"{f.name} " + (f"VARCHAR({limits[f.name]})" if f.name in limits else f.dataType.simpleString())
        for f in schemas.TABLES[table]
    )


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create the typed tables that do not exist yet.

    Lengths are enforced when writing. Files know no primary key; publishing checks it.
    """
    for table in schemas.TABLES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{table} ({_columns(table)}) USING parquet")


def append(df: DataFrame, table: str, database: str = "default") -> None:
    """Append rows to a typed table, columns in the table's order."""
    names = [f.name for f in schemas.TABLES[table]]
    df.select(*names).write.insertInto(f"{database}.{table}")


def materialise(df: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """Store a query's result as a table, instead of what the table held, and return it.

    The rows go to a folder of their own below ``location`` (by default beside the other tables);
    the table then is pointed to it, in one step of the catalog. So the query may read the table
    it replaces, readers see either the old rows or the new ones, and a query that fails leaves
    the old ones. The version before is kept for readers that have begun; older ones go.
    """
    spark = df.sparkSession
    base = location or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}.versions"
    exists = spark.catalog.tableExists(name)
    if exists and [(f.name, f.dataType) for f in spark.table(name).schema] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError(f"{name}: other columns than the table has")
    old = [n for n in names(spark, base) if n.startswith("version=")]
    version = f"version={int(old[-1][8:20]) + 1 if old else 1:012}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{base}/{version}")
    except BaseException:
        remove(spark, f"{base}/{version}")
        raise
    if exists:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{base}/{version}'")
        spark.catalog.refreshTable(name)
    else:
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{base}/{version}'")
    for gone in old[:-1]:
        remove(spark, f"{base}/{gone}")
    return spark.table(name)


def write_by_day(df: DataFrame, path: str, ts: str = "create_date") -> None:
    """Parquet files partitioned by calendar day, for scans that need a few days only.

    Rows are first gathered by day, so that a day does not end up in a file per task;
    rebalancing splits a day that is too large for one task.
    """
    dated = df.withColumn("create_day", F.to_date(ts))
    dated.hint("rebalance", "create_day").write.mode("overwrite").partitionBy("create_day").parquet(path)


def write_for_lookup(df: DataFrame, path: str, key: str, distinct_keys: int = 1_000_000) -> DataFrame:
    """Files in the order of a key, with bloom filters on it: a lookup skips nearly all row groups.

    The order goes on over the other columns, so that a key with very many rows spans files.
    ``distinct_keys`` is how many a row group may hold (it sizes the filters).
    """
    rest = [f.name for f in df.schema if f.name != key]
    ordered = df.repartitionByRange(key, *rest).sortWithinPartitions(key, *rest)
    bloom = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": distinct_keys}
    ordered.write.mode("overwrite").options(**bloom).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, location: str | None = None) -> DataFrame:
    """A table bucketed and sorted by key: two of them join on it without a shuffle.

    Meant for keys with few rows each; a bucket is read by one task, so choose as many that one
    fits a task's memory. For tables with hot keys see ``write_linked``.
    """
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer if location is None else writer.option("path", location)).saveAsTable(name)
    return df.sparkSession.table(name)


def write_linked(tables: dict[str, DataFrame], key: str, buckets: int, hot_rows: int, location: str) -> None:
    """Tables that are joined on a key, bucketed by it, except for rows of hot keys.

    A key is hot if any of the tables has ``hot_rows`` rows of it. Its rows, and those without a
    key, go to plain tables ``<name>_hot`` instead: one bucket could not be split among tasks.
    All tables deal out a key the same way, so buckets meet buckets only.
    """
    counts = [df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= hot_rows) & F.col(key).isNotNull()).select(key) for df in tables.values()]
    hot = reduce(DataFrame.unionByName, counts).distinct()
    path = f"{location}/hot-keys"
    hot.write.mode("overwrite").parquet(path)
    hot = hot.sparkSession.read.schema(hot.schema).parquet(path)
    for name, df in tables.items():
        cold = df.filter(F.col(key).isNotNull()).join(hot, key, "left_anti").select(df.columns)
        write_bucketed(cold, name, key, buckets, f"{location}/{name}")
        apart = df.join(hot, key, "left_semi").select(df.columns).unionByName(df.filter(F.col(key).isNull()))
        apart.write.mode("overwrite").format("parquet").option("path", f"{location}/{name}_hot").saveAsTable(f"{name}_hot")


def linked_counts(spark: SparkSession, left: str, right: str, key: str) -> DataFrame:
    """``key, n_left, n_right`` of two tables of ``write_linked``: buckets are counted and joined
    where they lie, rows of hot keys are counted before they are shuffled."""

    def counted(name: str, column: str) -> DataFrame:
        return spark.table(name).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias(column))

    none = F.lit(0).cast("bigint")
    cold = counted(left, "n_left").join(counted(right, "n_right"), "key", "full")
    cold = cold.select("key", F.coalesce("n_left", none).alias("n_left"), F.coalesce("n_right", none).alias("n_right"))
    return cold.unionByName(key_counts(spark.table(f"{left}_hot"), spark.table(f"{right}_hot"), key))
