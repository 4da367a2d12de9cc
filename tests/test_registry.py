"""Every registered query against DuckDB on the smallest scale factor."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect
from tillroll import registry

QUERIES, SQL = registry.QUERIES, registry.ORACLE_SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_matches_duckdb(spark, sf_dir, con, name):
    rows, differences = compare(QUERIES[name](spark, sf_dir), con, SQL[name])
    assert not differences
    assert rows > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["brand_name", "distinct_receipts"]
