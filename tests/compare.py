"""Runs queries beside their SQL and tells where the rows differ."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)) if v is not None else "", str(v)) for v in r))


def difference(spark, name: str, run, sql: str, folder: str, con=None) -> str | None:
    """None if the query and its SQL give the same columns and rows, else what differs first."""
    got = run(spark, folder)
    found = (con or connection(folder)).execute(sql)
    columns = [c[0] for c in found.description]
    if sorted(columns) != sorted(got.columns):
        return f"{name}: columns {sorted(got.columns)} and {sorted(columns)}"
    mine, theirs = rows_of(got.columns, got.collect()), rows_of(columns, found.fetchall())
    if len(mine) != len(theirs):
        return f"{name}: {len(mine)} rows and {len(theirs)}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"{name}: {sorted(columns)}\n  {a}\n  {b}"
    return None if mine else f"{name}: no rows"
