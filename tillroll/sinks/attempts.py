"""Batches of a stored table, each replaced as a whole.

Layout below a root: ``rows/batch=<id>/attempt=<uuid>/...`` and ``applied/<number>~<id>~<attempt>``.
An attempt counts once its mark exists; the newest mark of a batch is the valid one. So a batch
can be written, compared with its predecessor and only then put in its place, and whatever
fails before can be done again with the same outcome. Refreshes of one root run one after another.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tillroll.sinks.files import create_once, names, remove


def applied(spark: SparkSession, root: str) -> dict[str, str]:
    """The valid attempt of each batch."""
    return {batch: attempt for _, batch, attempt in (n.split("~") for n in names(spark, f"{root}/applied") if "~" in n)}


def new_attempt(batch: str) -> str:
    if "~" in batch or "/" in batch:
        raise ValueError(f"batch id {batch!r}: neither ~ nor / may be in it")
    return uuid.uuid4().hex


def folder(root: str, batch: str, attempt: str) -> str:
    return f"{root}/rows/batch={batch}/attempt={attempt}"


def apply(spark: SparkSession, root: str, batch: str, attempt: str) -> None:
    """Make an attempt the valid one of its batch, and remove the one before."""
    old = [n for n in names(spark, f"{root}/applied") if n.split("~")[1:2] == [batch]]
    number = max((int(n.split("~")[0]) for n in names(spark, f"{root}/applied") if "~" in n), default=0) + 1
    if not create_once(spark, f"{root}/applied/{number:012}~{batch}~{attempt}"):
        raise RuntimeError(f"{root}: refreshed by two at a time")
    for n in old:
        remove(spark, f"{root}/applied/{n}")
        remove(spark, folder(root, batch, n.split("~")[2]))
