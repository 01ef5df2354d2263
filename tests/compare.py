"""Rows of a Spark query against those of its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def database(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + ('/*.parquet' if os.path.isdir(p) else '')}'")
    return c


def same(frame, sql: str, sf: str) -> None:
    found = database(sf).sql(sql)
    assert sorted(found.columns) == sorted(frame.columns)
    columns = sorted(frame.columns)
    theirs = found.select(*(f'"{c}"' for c in columns)).fetchall()
    ours = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(map(repr, map(plain, ours))) == sorted(map(repr, map(plain, theirs)))
