"""Tables written to the folder that all executors share.

A written table cuts the lineage: what is computed once (a text scan, a random order, a
sampled range) is read back the same, also after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillroll.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, stored as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
