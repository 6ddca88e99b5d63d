"""Each query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from waymark import queries as paths

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(r[i] for i in order)) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(paths.QUERIES))
def test_sql_agrees(spark, name):
    got = paths.QUERIES[name](spark, SF)
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{SF}/events.parquet'")
    want = db.execute(paths.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_entry(spark):
    assert {r.path_length: r.n_paths for r in entry.entry(spark).collect()}.keys() == {2, 3}
