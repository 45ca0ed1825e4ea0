"""Compares a query with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def differences(spark, name: str, query, sql: str, sf_dir: str) -> str:
    con = duckdb.connect(config={"memory_limit": "8GB"})
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        at = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{at}'")
    a, b = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"{name}: columns {list(a.columns)} and {list(b.columns)}"
    columns = sorted(a.columns)
    if len(a) != len(b):
        return f"{name}: {len(a)} and {len(b)} rows"
    a, b = (x[columns].sort_values([c for c in columns if x[c].dtype.kind in "iu"] or columns).reset_index(drop=True) for x in (a, b))
    for c in columns:
        apart = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if apart.any():
            return f"{name}: {apart.sum()} values of {c} differ, such as {a[c][apart].iloc[0]} and {b[c][apart].iloc[0]}"
    return ""
