"""Every query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from inkwell.plans import queries as plans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query_equals_its_sql(spark, tables, name):
    found = plans.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)
    if name not in plans.ORACLES:
        assert rows
        return
    wanted = tables.sql(plans.ORACLES[name])
    assert sorted(wanted.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in at) for r in wanted.fetchall()), key=str)


def test_entry_module_has_all_queries():
    import __spark_entry__ as driver

    assert set(plans.QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())
