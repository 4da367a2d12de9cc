"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for counting: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(name: str = "text") -> Column:
    """The text column; a missing text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def row_key(text: Column, doc_id: Column) -> Column:
    """Rows with the same id and text have the same key, all others different ones (128 bits)."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), text).cast("binary"))


def hash_bucket(hexadecimal: Column, digits: int = 3) -> Column:
    """The first digits of a hexadecimal hash as a number: ranges of the hash's own order."""
    return F.conv(F.substring(hexadecimal, 1, digits), 16, 10).cast("int")
