"""DuckDB beside Spark: run a query's SQL on the same files and compare."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr(tuple(r[i] for i in order)) for r in rows)


def same(spark, con, df, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = con.execute(sql)
    want = rows_of([x[0] for x in r.description], r.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
