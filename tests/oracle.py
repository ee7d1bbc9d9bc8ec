"""Runs a query beside its SQL in DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def normal(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value.item() if hasattr(value, "item") else value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(df, con, sql: str) -> str:
    """An account of the first difference, or nothing."""
    got, want = rows_of(df.columns, df.collect()), con.execute(sql)
    names = [d[0] for d in want.description]
    want = rows_of(names, want.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""
