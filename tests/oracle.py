"""Runs SQL over the given tables and compares its rows with those of a DataFrame."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"create view {p.stem} as select * from read_parquet('{files}')")
    return con


def plain(x):
    if x is None or isinstance(x, (bool, str, bytes)):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, int):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        return x.replace(tzinfo=None)
    return x


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def same(a: tuple, b: tuple) -> bool:
    return all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-9) for x, y in zip(a, b, strict=True))


def check(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = [tuple(r) for r in df.collect()]
    answer = con.sql(sql)
    names, want = answer.columns, answer.fetchall()
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, got), rows(names, want)
    assert len(a) == len(b)
    unlike = [(x, y) for x, y in zip(a, b, strict=True) if not same(x, y)]
    # Values a hair apart may sort differently; a second look pairs the unlike rows without their doubles.
    if unlike:
        key = lambda r: repr([v for v in r if not isinstance(v, float)])
        x, y = sorted((u for u, _ in unlike), key=key), sorted((u for _, u in unlike), key=key)
        assert all(same(p, q) for p, q in zip(x, y, strict=True)), next((p, q) for p, q in zip(x, y, strict=True) if not same(p, q))
