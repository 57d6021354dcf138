"""Parameterised reads over the tables and models: the questions that an application asks.

A read that returns both a total and its first rows stages the matching rows, so that the model behind them runs once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage
from shelfwise.operators import forecast, kpis, segments
from shelfwise.operators.measures import Filters, filter_tables
from shelfwise.schemas import PAIR, Tables

# The accepted severities and segments.
SEVERITIES = ("Stockout", "Critical", "Low")
SEGMENTS = tuple(a + x for a in "ABC" for x in "XYZ")


def _exists(df: DataFrame, column: str, value: str) -> None:
    if df.filter(F.col(column) == value).isEmpty():
        raise LookupError(f"unknown {column} {value}")


def health_counts(t: Tables) -> DataFrame:
    """Rows of sales, products and warehouses."""
    rows = t.sales.agg(F.count("*").alias("sales_rows"))
    return rows.withColumns({"products": t.products.agg(F.count("*")).scalar(), "warehouses": t.warehouses.agg(F.count("*")).scalar()})


def choose(t: Tables, warehouse_id: str | None = None, category: str | None = None) -> Tables:
    """Tables of one warehouse and / or category; an unknown value is an error."""
    if warehouse_id:
        _exists(t.warehouses, "warehouse_id", warehouse_id)
    if category:
        _exists(t.products, "category", category)
    return filter_tables(t, Filters([warehouse_id] if warehouse_id else None, [category] if category else None))


def kpis_of(t: Tables, warehouse_id: str | None = None, category: str | None = None) -> DataFrame:
    """Headline of a selection; what was not sold or is not stocked counts as 0."""
    chosen = choose(t, warehouse_id, category)
    figures = kpis.headline(chosen.sales, chosen.inventory)
    return figures.select([F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c, kind in figures.dtypes])


def monthly_of(t: Tables, warehouse_id: str | None = None) -> DataFrame:
    return kpis.monthly_sales(choose(t, warehouse_id).sales).orderBy("month")


def alerts_of(t: Tables, warehouse_id: str | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
    """Most urgent alerts with the number of all that match."""
    if severity and severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    if warehouse_id:
        _exists(t.warehouses, "warehouse_id", warehouse_id)
    a = kpis.reorder_alerts(t.sales, t.inventory, t.products, t.warehouses)
    if warehouse_id:
        a = a.filter(F.col("warehouse_id") == warehouse_id)
    if severity:
        a = a.filter(F.col("severity") == severity)
    a = stage(a, "alerts")
    count = a.agg(F.count("*")).scalar()
    return a.orderBy(*kpis.by_urgency()).limit(limit).withColumn("count", count)


def replenishment_of(policy_rows: DataFrame, warehouse_id: str | None = None, only_due: bool = True, limit: int = 100) -> DataFrame:
    """Most expensive orders with count and cost of all that match."""
    r = policy_rows if warehouse_id is None else policy_rows.filter(F.col("warehouse_id") == warehouse_id)
    if only_due:
        r = r.filter("below_rop")
    r = stage(r, "orders")
    whole = r.agg(F.struct(F.count("*").alias("count"), F.coalesce(F.sum("suggested_order_cost"), F.lit(0)).alias("cost"))).scalar()
    return (r.orderBy(F.desc("suggested_order_cost"), *PAIR).limit(limit)
            .withColumns({"count": whole["count"], "total_cost": whole["cost"]}))


def transfers_of(transfers: DataFrame, limit: int = 100) -> DataFrame:
    transfers = stage(transfers, "transfers")
    count = transfers.agg(F.count("*")).scalar()
    ordered = transfers.orderBy(F.desc("value_at_cost"), "product_id", "from_warehouse", "to_warehouse")
    return ordered.limit(limit).withColumn("count", count)


def segment_of(t: Tables, segment: str | None = None, limit: int = 1000) -> DataFrame:
    """Products of one segment, largest revenue first, with the number of all that match."""
    if segment and segment not in SEGMENTS:
        raise ValueError(f"unknown segment {segment}")
    a = segments.abc_xyz(t.sales, t.products)
    if segment:
        a = a.filter(F.col("segment") == segment)
    a = stage(a, "segments")
    count = a.agg(F.count("*")).scalar()
    return a.orderBy(F.desc("revenue"), "product_id").limit(limit).withColumn("count", count)


def product_profile(t: Tables, policy_rows: DataFrame, product_id: str) -> dict[str, DataFrame]:
    """Master row, policy per warehouse and segment of one product."""
    forecast.require_product(t.products, product_id)
    mine = F.col("product_id") == product_id
    return {"product": t.products.filter(mine), "by_warehouse": policy_rows.filter(mine),
            "abc_xyz": segments.abc_xyz(t.sales, t.products).filter(mine)}


def forecast_with_check(t: Tables, product_id: str, horizon: int = 30, held_out: int = 30) -> DataFrame:
    """Daily forecast of one product, every row with the model check over all products; no check where history is too short."""
    days = forecast.product_forecast(t.sales, t.products, product_id, horizon)
    check = forecast.backtest(t.sales, held_out, t.products)
    enough = forecast.enough_history(t.sales).select("can_check").scalar()
    figures = check.agg(*[F.max(c).alias(c) for c in check.columns]).select(F.struct("*")).scalar()
    return days.withColumns({c: F.when(enough, figures[c]) for c in check.columns})
