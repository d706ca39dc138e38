"""Runs a registered query and its SQL on the same tables and compares them."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int,)):
        return float(value)
    if hasattr(value, "is_nan") or isinstance(value, float):
        number = float(value)
        return None if math.isnan(number) else number
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = [tuple(_normal(row[i]) for i in order) for row in rows]
    return names, sorted(data, key=repr)


def compare(spark, con, folder, query, sql):
    """Differences as text; empty when both give the same rows."""
    df = query(spark, folder)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        return f"{len(got)} rows != {len(want)}; only in Spark: {extra}"
    for g, w in zip(got, want):
        if g != w:
            where = [n for n, a, b in zip(got_names, g, w) if a != b]
            return f"differs in {where}: {[ (a, b) for a, b in zip(g, w) if a != b]}"[:800]
    return ""
