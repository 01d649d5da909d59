"""Run a registered query in Spark and its SQL in DuckDB and compare the results."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        value = round(value, 5)
        return 0.0 if value == 0 else value
    if hasattr(value, "as_tuple"):
        return ("decimal", float(value))
    return value


def _key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", v if v is not None else 0) for v in row)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=_key)


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-5 * max(1.0, abs(a), abs(b))
    return a == b and type(a) is type(b)


def compare(df, con, sql) -> str | None:
    """None when equal, else a description of the first difference."""
    left_cols, left = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    right_cols, right = table(cols, cur.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if not all(close(x, y) for x, y in zip(a, b)):
            bad = [(c, x, y) for c, x, y in zip(left_cols, a, b) if not close(x, y)]
            return f"first difference {bad[:4]} in {a[:6]}"
    return None
