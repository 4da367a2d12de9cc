"""Receipts as a stream of JSON-lines files, published as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillroll.operators.flatten import REASON, flatten_receipts
from tillroll.operators.joins import without_match
from tillroll.sinks.files import remove
from tillroll.sinks.publish import publish, published_keys
from tillroll.sources.jsonl import parse_lines


def publish_receipts(lines: DataFrame, root: str, batch: str) -> None:
    """Publish the receipts of some JSON lines that are not stored yet, and all rejects.

    Lines are parsed once, into a folder of the attempt. Of receipts that share an id the least
    one in the order of its columns is kept, so a replay publishes the same rows; receipts that
    other batches hold are left out. A batch that is published again replaces its first attempt.
    """
    spark = lines.sparkSession
    rows = flatten_receipts(parse_lines(lines))
    staged = f"{root}/staged/{uuid.uuid4().hex}"
    try:
        rows.write.parquet(staged)
        rows = spark.read.schema(rows.schema).parquet(staged)
        fine = rows.filter(F.col(REASON).isNull())
        new = fine.groupBy(F.col("receipt_id").alias("_id")).agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")
        new = without_match(new, published_keys(spark, root, "receipts", new, but=batch), "receipt_id").select(*rows.columns)
        publish(spark, root, batch, {"receipts": new.unionByName(rows.filter(F.col(REASON).isNotNull()))})
    finally:
        remove(spark, staged)


def start_receipt_feed(spark: SparkSession, source: str, root: str, checkpoint: str, name: str = "feed") -> StreamingQuery:
    """Publish what has arrived and stop; start again to continue where it stopped.

    Each micro-batch is a batch of its own below ``root``, named after its number, so one
    that is replayed after a failure replaces itself.
    """

    def load(lines: DataFrame, number: int) -> None:
        publish_receipts(lines, root, f"{name}-{number}")

    stream = spark.readStream.text(source).writeStream.foreachBatch(load)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
