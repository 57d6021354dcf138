"""Date windows over sales that skip the month folders outside them.

Clean sales lie in one folder per month. Where a frame still carries that folder as its last column, a window of days is also
stated on the months, so that files are skipped: while the plan is built for literal days, and at run time for days that a
scalar subquery yields, such as the last order day. Frames without the column are filtered by day alone.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH = "order_month"
DAY = "order_date"
#: Last order day of a row that sums several order lines; the first one is its DAY.
LAST_DAY = "last_order_date"


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def without_month(df: DataFrame) -> DataFrame:
    return df.drop(MONTH)


def _inside(sales: DataFrame, first: Column | None, last: Column | None) -> Column:
    day, month = F.col(DAY), F.col(MONTH)
    bounds = [day >= first] if first is not None else []
    bounds += [day <= last] if last is not None else []
    if MONTH in sales.columns:
        bounds += [month >= month_of(first)] if first is not None else []
        bounds += [month <= month_of(last)] if last is not None else []
    return reduce(Column.__and__, bounds, F.lit(True))


def within(sales: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Orders from the first to the last day, both included; no bound where None."""
    return sales.filter(_inside(sales, first, last))


def within_any(sales: DataFrame, spans: list[tuple[Column, Column]]) -> DataFrame:
    """Orders of any of the spans of days, in one scan."""
    return sales.filter(reduce(Column.__or__, [_inside(sales, first, last) for first, last in spans]))


def _end_month(sales: DataFrame, extreme) -> DataFrame:
    """Orders of the first or last month that has any; finding it reads no column of the files."""
    return sales.filter(F.col(MONTH) == sales.agg(extreme(MONTH)).scalar()) if MONTH in sales.columns else sales


def first_day(sales: DataFrame) -> Column:
    """Earliest order date as a scalar subquery."""
    return _end_month(sales, F.min).agg(F.min(DAY)).scalar()


def last_day(sales: DataFrame) -> Column:
    """Latest order date as a scalar subquery."""
    return _end_month(sales, F.max).agg(F.max(DAY)).scalar()


def recent(sales: DataFrame, window_days: int) -> DataFrame:
    """Exactly the last `window_days` days up to the latest order."""
    return within(sales, F.date_sub(last_day(sales), window_days - 1))
