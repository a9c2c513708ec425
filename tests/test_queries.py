"""Every query with SQL gives the rows DuckDB gives, on the smallest tables; every other one runs."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from verify import rows

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="test tables not there")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(BASE).iterdir():
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, BASE).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["symbol", "gap_start", "gap_end"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
