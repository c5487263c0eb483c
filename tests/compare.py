"""Comparison of a Spark query with DuckDB SQL over the tables of a folder."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def from_spark(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def from_duckdb(sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return sorted(names), rows(names, out.fetchall())


def same(df, sql, sf_dir):
    """Asserts that both have the same columns and rows."""
    (a, x), (b, y) = from_spark(df), from_duckdb(sql, sf_dir)
    assert a == b
    assert len(x) == len(y), (len(x), len(y), x[:2], y[:2])
    differ = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    assert not differ, (len(differ), differ[:3])
