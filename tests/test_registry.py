"""Every registered query against its SQL twin, on the small tables."""

import os
import sys

import duckdb
import pytest
from conftest import ROOT, SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as registry  # noqa: E402
from check_oracle import rows_of  # noqa: E402

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in sorted(os.listdir(SMALL)):
        con.execute(f"create view {name.removesuffix('.parquet')} as "
                    f"select * from read_parquet('{SMALL}/{name}')")
    return con


def test_twins_have_queries():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    found = registry.queries()[name](spark, SMALL)
    got = rows_of(found.columns, found.collect())
    assert got
    if name in SQL:
        result = con.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(found.columns)
        assert got == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert registry.entry(spark).columns == ["doc_id", "score"]
