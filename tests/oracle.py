"""Comparison of a query with its SQL over the smallest tables."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def views(sf=SF):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def same(df, sql, sf=SF):
    names = sorted(df.columns)
    ours = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=str)
    found = views(sf).sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert ours == theirs
    return len(ours)
