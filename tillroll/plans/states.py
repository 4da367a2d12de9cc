"""Key figures from states that batches leave behind and that add up.

A batch's state of a column is the number of rows of each value, NULL included. States of
several batches are merged by adding, and profiles, missing values and linkage follow from the
merged ones: nothing is read of the batches themselves again. A batch that is added again
replaces its states (see ``sinks/attempts.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.numbers import percent
from tillroll.operators.linkage import profile_of, summary_of
from tillroll.sinks import attempts

STATE = "key string, key_rows bigint"


def key_state(df: DataFrame, key: str) -> DataFrame:
    """``key, key_rows``: counted before the shuffle, so a hot key is a row per task."""
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("key_rows"))


def add_states(spark: SparkSession, root: str, batch: str, columns: dict[str, tuple[DataFrame, str]]) -> None:
    """Store a batch's states: ``columns`` maps a state's name to rows and their column."""
    attempt = attempts.new_attempt(batch)
    for name, (df, key) in columns.items():
        key_state(df, key).write.parquet(f"{attempts.folder(root, batch, attempt)}/{name}")
    attempts.apply(spark, root, batch, attempt)


def merged(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The state of all batches in place."""
    paths = [f"{attempts.folder(root, batch, attempt)}/{name}" for batch, attempt in attempts.applied(spark, root).items()]
    each = spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)
    return each.groupBy("key").agg(F.sum("key_rows").alias("key_rows"))


def column_profile(state: DataFrame, column: str) -> DataFrame:
    """Rows, distinct values, values that occur more than once and missing values of a column."""
    keyed = F.col("key").isNotNull()
    zero = F.lit(0).cast("bigint")
    found = state.agg(
        F.coalesce(F.sum("key_rows"), zero).alias("total_rows"),
        F.count_if(keyed).alias("distinct_keys"),
        F.count_if(keyed & (F.col("key_rows") > 1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(~keyed, F.col("key_rows"))), zero).alias("null_rows"),
    )
    return found.select(F.lit(column).alias("column_name"), "*", percent(F.col("null_rows"), F.col("total_rows")).alias("null_pct"))


def _counts(left: DataFrame, right: DataFrame) -> DataFrame:
    none = F.lit(0).cast("bigint")
    sides = left.select("key", F.col("key_rows").alias("n_left"), none.alias("n_right")).unionByName(
        right.select("key", none.alias("n_left"), F.col("key_rows").alias("n_right"))
    )
    return sides.groupBy("key").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))


def linkage_profile(left: DataFrame, right: DataFrame) -> DataFrame:
    return profile_of(_counts(left, right))


def linkage_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    return summary_of(_counts(left, right))
