"""Runs a registered query and its SQL side by side and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)) and value == int(value):
        return int(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else value
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark_df, con, sql):
    """None when equal, else a description of the first difference."""
    cols_s, rows_s = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    cols_d, rows_d = rows_of([d[0] for d in res.description], res.fetchall())
    if cols_s != cols_d:
        return f"columns {cols_s} vs {cols_d}"
    if len(rows_s) != len(rows_d):
        only_s, only_d = set(rows_s) - set(rows_d), set(rows_d) - set(rows_s)
        return f"{len(rows_s)} rows vs {len(rows_d)}; only spark {list(only_s)[:2]}; only sql {list(only_d)[:2]}"
    diff = [(a, b) for a, b in zip(rows_s, rows_d) if a != b]
    if diff:
        return f"{len(diff)} of {len(rows_s)} rows differ: {diff[0]}"
    return None
