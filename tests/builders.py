"""Small canonical tables and series for tests."""
from __future__ import annotations

import datetime as dt

from shelfwise.schemas import SALES, conform


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def frame(spark, schema, rows):
    """A canonical table from rows with plain numbers."""
    names = ", ".join(f"{f.name} {'double' if 'decimal' in f.dataType.simpleString() else f.dataType.simpleString()}" for f in schema.fields)
    return conform(spark.createDataFrame(rows, names), schema)


def daily_sales(spark, units_of: dict, days: int, start: str = "2025-01-01"):
    """Sales of one warehouse from functions day index -> units."""
    first = day(start)
    rows = [(f"{p}{i}", first + dt.timedelta(days=i), "W1", p, q, 2.0, 2.0 * q)
            for p, f in units_of.items() for i in range(days) if (q := f(i)) > 0]
    return frame(spark, SALES, rows)


def market_day(i: int) -> int:
    """Eight times as much on Wednesdays."""
    return 24 if (day("2025-01-01") + dt.timedelta(days=i)).weekday() == 2 else 3


def by(df, *keys):
    """Collected rows by key."""
    rows = df.collect()
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
