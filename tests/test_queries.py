"""Every query against its SQL in another engine, on the smallest tables."""

import duckdb
import pytest
from conftest import DATA

from ramify import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    plain = frame.astype(object).where(frame.notna(), None)
    return sorted(map(repr, map(tuple, plain.values.tolist())))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_parity(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(queries.SQL[name]).df()
    assert sorted(want.columns) == columns
    assert rows(got.select(*columns).toPandas()) == rows(want[columns])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["network_id", "x", "y", "z"]
