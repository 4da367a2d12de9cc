"""Connection options and writer for a JDBC database."""

from __future__ import annotations

from pyspark.sql import DataFrame

DEFAULT_PORT = 5432
DEFAULT_BATCH = 10_000


def jdbc_options(
    host: str,
    database: str,
    user: str,
    password: str,
    port: int = DEFAULT_PORT,
    batch_size: int = DEFAULT_BATCH,
) -> dict[str, str]:
    """Options for Spark's JDBC source and sink, from values the caller supplies."""
    return {
        "url": f"jdbc:postgresql://{host}:{port}/{database}",
        "user": user,
        "password": password,
        "batchsize": str(batch_size),
        # Text columns of unbounded length; ids and codes are declared by the DDL.
        "stringtype": "unspecified",
    }


def append_jdbc(df: DataFrame, table: str, options: dict[str, str], connections: int = 16) -> None:
    """Append a table over at most ``connections`` parallel connections.

    Each task commits on its own, so a failed job may leave rows behind: write to a
    loading table and let the database move the rows in one transaction.
    """
    # Dealt out before the write, so that only the write is as narrow as the connections.
    writer = df.repartition(connections).write.format("jdbc").mode("append").options(**options)
    writer.option("dbtable", table).save()
