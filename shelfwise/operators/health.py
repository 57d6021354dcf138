"""Cash and risk summary of the stock: value, excess, dead stock, items at risk."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import half_up, ratio
from shelfwise.functions.months import recent
from shelfwise.functions.ordering import median
from shelfwise.functions.staging import stage
from shelfwise.schemas import PAIR

HEALTH_COLUMNS = ["current_stock", "stock_value", "excess_value", "suggested_order_cost", "stockout_risk_pct", "days_of_cover"]


def dead_stock(sales: DataFrame, policy_rows: DataFrame, dead_days: int = 90) -> DataFrame:
    """Positions with stock but without a sale in the last `dead_days` days."""
    active = recent(sales, dead_days).select(*PAIR).distinct()
    return policy_rows.filter(F.col("current_stock") > 0).join(active, PAIR, "left_anti")


def inventory_health(sales: DataFrame, policy_rows: DataFrame, dead_days: int = 90, risk_threshold: float = 50.0) -> DataFrame:
    """One row with the cash and risk figures of a set of stock positions."""
    # three figures start from the rows: stage them instead of deriving the policy three times
    policy_rows = stage(policy_rows.select(*PAIR, *HEALTH_COLUMNS), "health")

    def money(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    totals = policy_rows.agg(
        money("stock_value"), money("excess_value"), money("suggested_order_cost"),
        F.count_if(F.col("stockout_risk_pct") >= risk_threshold).alias("at_risk_items"))
    dead = dead_stock(sales, policy_rows, dead_days).agg(
        F.struct(F.count("*").alias("items"), money("stock_value").alias("value"))).scalar()
    cover = F.lit(median(policy_rows, F.col("days_of_cover"))).cast("double")
    excess = F.coalesce(half_up(ratio(F.col("excess_value") * 100, F.col("stock_value")), 1), F.lit(0.0))
    return totals.select(
        "stock_value", "excess_value", excess.alias("excess_pct"), dead["items"].alias("dead_stock_items"),
        dead["value"].alias("dead_stock_value"), "at_risk_items", cover.alias("median_days_of_cover"),
        F.col("suggested_order_cost").alias("suggested_po_value"))
