"""Comparison of a query with its SQL."""

import glob
import os

import duckdb


def tables(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def same_rows(df, sql, connection):
    """Both results as sets of rows with counts, columns by name."""
    names = sorted(df.columns)
    got = sorted(repr(tuple(x[n] for n in names)) for x in df.collect())
    found = connection.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    want = sorted(repr(tuple(x[i] for i in at)) for x in found.fetchall())
    assert got == want
