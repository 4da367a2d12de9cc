"""How completely two tables link up over a key.

All figures follow from the number of rows each side has per key. Both sides are
counted in one aggregation over their union: map-side counting shrinks a hot key (and
NULL) to one row per task, one exchange brings the counts together, and the join, whose
output may be far larger than its inputs, is never made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numbers import percent


def key_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, n_left, n_right``: rows per key on both sides."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = left.select(F.col(key).alias("key"), one.alias("l"), none.alias("r")).unionByName(
        right.select(F.col(key).alias("key"), none.alias("l"), one.alias("r"))
    )
    return sides.groupBy("key").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def _total(rows: Column) -> Column:
    return F.coalesce(F.sum(rows), F.lit(0).cast("bigint"))


def _on(side: str) -> Column:
    """Whether a side has the key, which is not NULL."""
    return F.col("key").isNotNull() & (F.col(side) > 0)


def profile_of(counts: DataFrame) -> DataFrame:
    """``linkage_profile`` of rows per key: ``key, n_left, n_right``."""
    keyed = F.col("key").isNotNull()
    joined = F.col("n_left") * F.when(keyed, F.greatest("n_right", F.lit(1))).otherwise(F.lit(1))
    return counts.agg(
        _total(joined).alias("joined_rows"),
        _total(F.when(keyed, joined)).alias("left_non_null"),
        F.count_if(_on("n_left")).alias("left_distinct"),
        _total(F.when(keyed, F.col("n_left") * F.col("n_right"))).alias("right_non_null"),
        F.count_if(_on("n_left") & _on("n_right")).alias("right_distinct"),
    )


def linkage_profile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Figures of ``left LEFT JOIN right``: joined rows, and the rows with a key and the
    distinct keys of either side among them."""
    return profile_of(key_counts(left, right, key))


def summary_of(counts: DataFrame) -> DataFrame:
    """``linkage_summary`` of rows per key: ``key, n_left, n_right``."""
    on_left, on_right, no_key = _on("n_left"), _on("n_right"), F.col("key").isNull()
    counted = counts.agg(
        F.count_if(on_left).alias("left_keys"),
        F.count_if(on_right).alias("right_keys"),
        F.count_if(on_left & on_right).alias("matched_keys"),
        F.count_if(on_left & ~on_right).alias("left_orphans"),
        F.count_if(~on_left & on_right).alias("right_orphans"),
        _total(F.col("n_left")).alias("left_rows"),
        _total(F.when(no_key, F.col("n_left"))).alias("left_null_rows"),
        _total(F.when(no_key, F.col("n_right"))).alias("right_null_rows"),
    )
    return counted.withColumns(
        {
            "left_coverage_pct": percent(F.col("matched_keys"), F.col("left_keys")),
            "left_orphan_pct": percent(F.col("left_orphans"), F.col("left_keys")),
            "right_orphan_pct": percent(F.col("right_orphans"), F.col("right_keys")),
        }
    )


def linkage_summary(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Matched and orphaned keys in both directions, and rows without a key."""
    return summary_of(key_counts(left, right, key))
