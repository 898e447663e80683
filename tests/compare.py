"""Rows of a query against rows of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def duck(folder=FOLDER):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(df, con, sql):
    got = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    columns = sorted(df.columns)
    assert columns == sorted(names)
    at = [names.index(c) for c in columns]
    left = sorted((tuple(plain(r[c]) for c in columns) for r in got), key=repr)
    right = sorted((tuple(plain(r[i]) for i in at) for r in want), key=repr)
    assert left == right
