"""Every registered query equals its SQL twin, value by value."""

import duckdb
import pytest

from checks.compare import compare, connect
from checks.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    same, _, _, difference = compare(spark, con, SF, name, QUERIES[name], ORACLE.get(name))
    assert same, difference


def test_entry(spark):
    import __spark_entry__ as entry

    counts = {r["category"]: r["count"] for r in entry.entry(spark).collect()}
    assert counts == {"Credit Card": 4, "Email Address": 5, "Phone Number": 6}
    assert set(entry.oracle_sql()) <= set(entry.queries())
