"""Compare a query with its SQL on the same Parquet tables."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def duck(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{at}')")
    return con


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def same(spark, query, sql: str, sf_dir: str = SF) -> int:
    df = query(spark, sf_dir)
    found = duck(sf_dir).execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, found.fetchall())
    assert got == want
    return len(got)
