"""Runs queries beside their SQL and compares all values."""

import math
import os

import duckdb

DATA = os.environ.get("TESSELLA_TESTDATA", "/root/testdata")


def connection(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    return con


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return repr(float(v))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


def same(spark, query, sql, folder):
    df = query(spark, folder)
    con = connection(folder)
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, out.fetchall())
