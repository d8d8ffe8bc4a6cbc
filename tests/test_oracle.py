"""Every registered query against DuckDB on the driver tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from traceprofile.testing import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_duckdb(spark, con, name):
    rows, problem = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None and rows > 0


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
