"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    made = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        made.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return made


def plain(value):
    if isinstance(value, float):
        return round(value, 8) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    rows = [tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    if name not in SQL:
        assert rows
        return
    told = con.execute(SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in told.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
    for problem in (1, 2, 3, 5, 6):
        assert f"p{problem}_found" in QUERIES
