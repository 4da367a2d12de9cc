"""Receipts per day, kept up to date on the stream.

The running numbers are the state of a stateful aggregation: for each day and a few shares of its
receipts (so that a day with a third of all receipts is not one task) how many came in time and
how many late, behind the watermark. An engine's own windowed aggregation drops late rows; here
they are counted apart, so both numbers together are all receipts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tillroll.operators.flatten import accepted, flatten_receipts
from tillroll.sinks.files import names
from tillroll.sources.jsonl import parse_lines

STATE = "on_time bigint, late bigint"
COUNTS = f"day date, share int, {STATE}"


def _count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    on_time, late = state.get if state.exists else (0, 0)
    watermark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
    for frame in frames:
        # The session's time zone is UTC; receipts without a date are never late.
        behind = int((frame["create_date"] < watermark).sum())
        on_time, late = on_time + len(frame) - behind, late + behind
    state.update((on_time, late))
    yield pd.DataFrame({"day": [key[0]], "share": [key[1]], "on_time": [on_time], "late": [late]})


def start_daily_counts(
    spark: SparkSession, source: str, root: str, checkpoint: str, delay: str = "30 days", shares: int = 8, files: int | None = None
) -> StreamingQuery:
    """Count what has arrived and stop; start again to continue where it stopped.

    Each micro-batch (of at most ``files`` files) stores the numbers it changed below ``root``,
    in a folder of its own, which a replay replaces.
    """
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    receipts = accepted(flatten_receipts(parse_lines(reader.text(source)))).select("receipt_id", "create_date")
    dated = receipts.withWatermark("create_date", delay).select(
        F.to_date("create_date").alias("day"), F.pmod(F.hash("receipt_id"), F.lit(shares)).alias("share"), "create_date"
    )
    counted = dated.groupBy("day", "share").applyInPandasWithState(_count, COUNTS, STATE, "update", GroupStateTimeout.NoTimeout)

    def store(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{root}/batch={number}")

    stream = counted.writeStream.foreachBatch(store).outputMode("update")
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_daily_counts(spark: SparkSession, root: str) -> DataFrame:
    """``day, day_rows, late_rows``: numbers only grow, so the largest are the newest."""
    if not names(spark, root):
        return spark.createDataFrame([], "day date, day_rows bigint, late_rows bigint")
    newest = spark.read.schema(f"{COUNTS}, batch int").parquet(root).groupBy("day", "share").agg(F.max("on_time").alias("on_time"), F.max("late").alias("late"))
    return newest.groupBy("day").agg(F.sum(F.col("on_time") + F.col("late")).alias("day_rows"), F.sum("late").alias("late_rows"))
