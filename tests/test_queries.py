"""Every query against its SQL on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from termloom import queries as q

SF = os.environ.get("TERMLOOM_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return float(value) if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_equals_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(q.ORACLES[name])
    columns = [c[0] for c in found.description]
    want = rows_of(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_gives_rows(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0
