"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # Calendar months and days are UTC months and days.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object that repeats a key keeps the last value instead of being refused.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Hot keys: AQE splits the oversized partitions of a shuffled join, even where
    # that costs the plan one more exchange further up.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Folders of many days are listed by so many tasks, not by a task for each of them.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}

#: For a session of one's own: HotSpot does not compile methods above 8000 bytes of bytecode.
#: Beyond that a fused stage runs interpreted and is slower than separately compiled expressions.
FUSED_CODE = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tillroll")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in (SETTINGS | FUSED_CODE).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Where neither it nor a
    checkpoint directory is set, a session on one machine (tests) uses a folder of its own;
    on a cluster that would be another folder on each machine, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tillroll-')}"
