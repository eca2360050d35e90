"""Shared by the tests: comparison of a query with its SQL."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else p
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return [rel.columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def assert_same(df, con, sql: str) -> int:
    a, b = rows_of(df), rows_of_sql(con, sql)
    assert a[0] == b[0], (a[0], b[0])
    only_a, only_b = set(a[1]) - set(b[1]), set(b[1]) - set(a[1])
    assert a[1] == b[1], f"{len(a[1])} and {len(b[1])} rows; only Spark: {list(only_a)[:3]}; only SQL: {list(only_b)[:3]}"
    return len(a[1])
