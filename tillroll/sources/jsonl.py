"""JSON-lines sources.

A source becomes a table of documents with three columns:

* ``line``: the text as it stands in the file,
* ``document``: the parsed VARIANT, NULL when the line could not be used,
* ``line_error``: why it could not be used, else NULL.

Blank lines are no documents. The files are read as text, so Spark splits large
files, and each line is parsed once, on the executor that read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.fields import computed, is_object

MODES = ("lenient", "strict")

# The parser stops at the end of the first value and would overlook text behind it
# ('{"a": 1} oops'). A line is therefore parsed as the first element of an array that
# has this mark as its second and last element.
_MARK = "end of line"
# The parser refuses longer single texts; by default those of 20 million characters.
_LONGEST = str((1 << 31) - 1)


def _parse(line: Column) -> Column:
    """The elements of that array, all in one cast: a path that leads nowhere is dear, and most lines have no third one."""
    wrapped = F.concat(F.lit("["), line, F.lit(f',"{_MARK}"]'))
    parsed = F.from_json(wrapped, "variant", {"allowSingleQuotes": "false", "maxStringLen": _LONGEST})
    return F.try_variant_get(parsed, "$", "array<variant>")


def _first_element(elements: Column) -> Column:
    closed = F.get(elements, 1).try_cast("string") == _MARK
    return F.when((F.size(elements) == 2) & closed, F.get(elements, 0))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parse a text column that holds one JSON document per row."""
    # A text that is itself computed is not computed again for the filter.
    lines = computed(lines, F.col(column).alias("line")).filter(F.col("line").rlike(r"\S"))
    line, elements, document = F.col("line"), F.col("elements"), F.col("document")
    parsed_lines = lines.select(line, _parse(line).alias("elements"))
    documents = computed(parsed_lines, line, _first_element(elements).alias("document"))
    error = F.when(document.isNull(), F.lit("not valid JSON")).when(
        ~is_object(document), F.lit("not an object")
    )
    return documents.withColumn("line_error", error)


def refuse_bad_lines(documents: DataFrame) -> DataFrame:
    """Fail the query that meets an undecodable line (in its own pass over the data)."""
    bad = F.col("line_error") == "not valid JSON"
    refusal = F.raise_error(
        F.concat(F.lit("undecodable line in a strict source: "), F.col("line"))
    )
    # Both columns refuse, since a query may use one without the other.
    return documents.withColumns(
        {c: F.when(bad, refusal).otherwise(F.col(c)) for c in ("document", "line_error")}
    )


def read_jsonl(spark: SparkSession, path: str | list[str], mode: str = "lenient") -> DataFrame:
    """Documents of a JSON-lines source.

    ``lenient`` keeps undecodable lines as rows with a ``line_error``, which flattening
    turns into rejects. ``strict`` fails the source when a single line is undecodable.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    documents = parse_lines(spark.read.text(path))
    return refuse_bad_lines(documents) if mode == "strict" else documents


class EmptySourceError(ValueError):
    """A source without a single usable document."""


def require_documents(documents: DataFrame, name: str) -> DataFrame:
    """Raise when the source holds no valid document; stops reading at the first one."""
    if documents.filter(F.col("line_error").isNull()).isEmpty():
        raise EmptySourceError(f"no valid JSON document in {name}")
    return documents
