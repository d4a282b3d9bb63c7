"""Runs a query and the SQL that checks it on the same tables and compares the rows as values."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for p in Path(sf_dir).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    return con


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    rel = connect(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    order = [names.index(c) for c in df.columns]
    want = sorted((repr(tuple(plain(r[k]) for k in order)) for r in rel.fetchall()))
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.collect())
    if want != got:
        a, b = set(want), set(got)
        return f"{name}: {len(got)} rows, wanted {len(want)}; missing {sorted(a - b)[:2]}, extra {sorted(b - a)[:2]}"
    return ""
