"""Compares a Spark query with its DuckDB twin over the same Parquet tables."""

from __future__ import annotations

import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            path = f"{sf_dir}/{name}"
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _value(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 8) + 0.0
    return v


def rows(table) -> list[tuple]:
    """Rows of an Arrow table with columns by name, sorted, numbers made comparable."""
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(_value(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else _value(str(v) if not isinstance(v, (str, bool, type(None))) else v) for v in r) for r in zip(*cols)), key=repr)


def check(spark, sf_dir: str, query, sql: str) -> None:
    got = query(spark, sf_dir).toArrow()
    want = connect(sf_dir).execute(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
