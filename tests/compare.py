"""Order-insensitive comparison of a Spark result with a DuckDB result."""
from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (float(f"{value:.12g}") + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _kind(value):
    return type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str | None:
    """None when equal, else a short account."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(set(columns) ^ set(df.columns))}"
    if len(want) != len(got):
        return f"rows: spark {len(got)}, sql {len(want)}; only spark {sorted(set(got) - set(want), key=repr)[:3]} only sql {sorted(set(want) - set(got), key=repr)[:3]}"
    for a, b in zip(got, want):
        kinds = [(x, y) for x, y in zip(a, b) if x is not None and y is not None and _kind(x) != _kind(y)]
        if kinds:
            return f"types {sorted(columns)}: {kinds}"
    if want != got:
        only_got, only_want = sorted(set(got) - set(want), key=repr), sorted(set(want) - set(got), key=repr)
        return f"{len(only_got)} rows differ {sorted(columns)}; spark {only_got[:2]} sql {only_want[:2]}"
    return None
