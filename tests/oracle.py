"""Comparison of a Spark result with DuckDB's answer over the same parquet files."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb

KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def _rows(rows, order):
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(df, con, sql) -> tuple[int, list[str]]:
    """Number of rows and a list of differences (empty: equal)."""
    names = df.columns
    want = con.execute(sql)
    want_types = {c[0]: str(c[1]) for c in want.description}
    if sorted(names) != sorted(want_types):
        return 0, [f"columns {sorted(names)} <> {sorted(want_types)}"]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [
        f"{c}: {types[c]} <> {want_types[c]}" for c in names if KINDS.get(types[c]) != want_types[c]
    ]
    order = sorted(names)
    got = _rows(df.collect(), [names.index(c) for c in order])
    expected = _rows(want.fetchall(), [list(want_types).index(c) for c in order])
    if got != expected:
        where = next((p for p in zip(got, expected) if p[0] != p[1]), "one has more rows")
        wrong.append(f"{len(got)} <> {len(expected)} rows, first difference {where}")
    return len(got), wrong
