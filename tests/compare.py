"""Compares a query's rows with DuckDB's."""

import glob
import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


def duck(sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def same(df, sql, sf):
    names, rows = duck(sql, sf)
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rows), key=repr)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
