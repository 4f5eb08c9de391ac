"""Runs a query and its SQL over one folder of tables and compares the rows."""

import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "item"):
        return _plain(v.item())
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)


def same(df, sql, folder=None, **tables):
    con = duckdb.connect()
    for name in os.listdir(folder) if folder else ():
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    for name, t in tables.items():
        con.register(name, t)
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    cols, ours = rows(df)
    assert sorted(names) == cols
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=str)
    assert len(ours) == len(theirs)
    assert ours == theirs
