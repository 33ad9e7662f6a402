"""Every query with SQL against DuckDB on the smallest tables, and the driver's contract."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import oracle

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
SQL = entry.oracle_sql()


def test_contract(spark):
    assert set(SQL) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    ok, said = oracle.compare(spark, con, entry.queries()[name], SQL[name], FOLDER)
    assert ok, said
