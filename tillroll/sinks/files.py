"""Names, marks and removal of files on the shared file system, through Spark's own client.

All of it is metadata on the driver: no row passes through here.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _client(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly below a folder, sorted; nothing where there is no such folder."""
    client, place = _client(spark, path)
    if not client.exists(place):
        return []
    return sorted(status.getPath().getName() for status in client.listStatus(place))


def create_once(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a file that must not exist; False where another writer was first."""
    client, place = _client(spark, path)
    try:
        out = client.create(place, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file, or a folder with everything in it, if it is there."""
    client, place = _client(spark, path)
    client.delete(place, True)
