"""Compares a query with its SQL over the same tables in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v


def same(df, con, sql: str) -> int:
    """Asserts equal columns and rows in any order; gives the number of rows."""
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    at = [rel.columns.index(c) for c in names]
    own = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    assert own == want
    return len(own)
