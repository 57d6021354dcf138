"""Replenishment policy per warehouse and product, and what-if scenarios on it."""
from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import half_up, normal_cdf, positive, ratio
from shelfwise.operators.demand import demand_stats
from shelfwise.schemas import PAIR, Policy

# Fixed value: delays in days of the supplier-delay curve.
DELAYS = (0, 3, 7, 14, 21)

POLICY_COLUMNS = [
    "warehouse_id", "warehouse_name", "product_id", "product_name", "category", "current_stock", "reorder_level",
    "mean_daily", "std_daily", "lead_time_days", "safety_stock", "reorder_point", "eoq", "order_up_to", "below_rop",
    "suggested_order_qty", "suggested_order_cost", "stockout_risk_pct", "excess_units", "excess_value", "stock_value",
    "policy_gap", "days_of_cover",
]


def z_for(service_level: float) -> float:
    """Safety factor of a service level."""
    return NormalDist().inv_cdf(service_level)


def stockout_risk(stock: Column, mean: Column, deviation: Column, lead_time: Column) -> Column:
    """Probability that normal demand over the lead time exceeds the stock; certain for an empty shelf that sells."""
    expected, spread = mean * lead_time, deviation * F.sqrt(lead_time)
    drawn = F.lit(1.0) - normal_cdf(ratio(stock - expected, spread))
    return (F.when((stock <= 0) & (mean > 0), 1.0).when(spread > 0, drawn)
            .otherwise((stock < expected).cast("double")))


def _positions(sales: DataFrame, inventory: DataFrame, products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Stock positions with demand statistics and master data. Aggregates and inventory share the pair partitioning."""
    return (inventory.join(demand_stats(sales), PAIR, "left")
            .join(products.select("product_id", "product_name", "category", "unit_cost", "lead_time_days"), "product_id")
            .join(warehouses.select("warehouse_id", "warehouse_name"), "warehouse_id")
            .fillna(0.0, ["mean_daily", "std_daily"]))


def _apply_policy(positions: DataFrame, z: Column, ordering_cost: Column, holding_rate: Column, extra: Column) -> DataFrame:
    c = F.col
    r = positions.withColumn("lead_time_days", c("lead_time_days") + extra)
    r = r.withColumn("safety_stock", F.ceil(z * c("std_daily") * F.sqrt("lead_time_days")))
    r = r.withColumn("reorder_point", F.ceil(c("mean_daily") * c("lead_time_days") + c("safety_stock")))
    holding = positive(holding_rate * c("unit_cost").cast("double"))
    r = r.withColumn("eoq", F.coalesce(F.ceil(F.sqrt(ratio(F.lit(2) * c("mean_daily") * F.lit(365) * ordering_cost, holding))), F.lit(0)))
    r = r.withColumn("order_up_to", c("reorder_point") + c("eoq"))
    r = r.withColumn("below_rop", c("current_stock") <= c("reorder_point"))
    due = F.greatest(c("order_up_to") - c("current_stock"), F.lit(0))
    r = r.withColumn("suggested_order_qty", F.when(c("below_rop"), due).otherwise(F.lit(0)).cast("int"))
    r = r.withColumn("excess_units", F.greatest(c("current_stock") - c("order_up_to"), F.lit(0)).cast("int"))
    risk = stockout_risk(c("current_stock"), c("mean_daily"), c("std_daily"), c("lead_time_days"))

    def at_cost(units: str) -> Column:
        return F.round(c(units) * c("unit_cost"), 2)

    return r.withColumns({
        "suggested_order_cost": at_cost("suggested_order_qty"), "excess_value": at_cost("excess_units"),
        "stock_value": at_cost("current_stock"), "stockout_risk_pct": half_up(risk * 100, 1),
        "policy_gap": c("reorder_point") - c("reorder_level"),
        "days_of_cover": half_up(ratio(c("current_stock"), positive(c("mean_daily"))), 1)})


def replenishment(sales: DataFrame, inventory: DataFrame, products: DataFrame, warehouses: DataFrame,
                  policy: Policy = Policy()) -> DataFrame:
    """Safety stock, reorder point, order quantity, suggested order, stockout risk and excess per stock position."""
    r = _apply_policy(_positions(sales, inventory, products, warehouses), F.lit(policy.z), F.lit(float(policy.ordering_cost)),
                      F.lit(float(policy.holding_rate)), F.lit(float(policy.lead_time_extra_days)))
    rounded = {name: half_up(F.col(name), 3) for name in ("mean_daily", "std_daily")}
    return r.withColumns(rounded).select(*POLICY_COLUMNS)


def delay_curve(sales: DataFrame, inventory: DataFrame, products: DataFrame, warehouses: DataFrame,
                policy: Policy = Policy(), delays: tuple[int, ...] = DELAYS, risk_threshold: float = 50.0) -> DataFrame:
    """Purchase value and items at risk per supplier delay. Demand is aggregated once; each position is then priced per delay."""
    scenarios = F.explode(F.array(*[F.lit(d) for d in delays])).alias("supplier_delay_days")
    positions = _positions(sales, inventory, products, warehouses).select("*", scenarios)
    r = _apply_policy(positions, F.lit(policy.z), F.lit(float(policy.ordering_cost)), F.lit(float(policy.holding_rate)),
                      F.col("supplier_delay_days").cast("double"))
    return r.groupBy("supplier_delay_days").agg(
        F.sum("suggested_order_cost").alias("purchase_order_value"),
        F.count_if(F.col("stockout_risk_pct") >= risk_threshold).alias("items_at_risk")).orderBy("supplier_delay_days")


# ------------------------------------------------------------------------------------------------ reads of the policy
def orders_to_place(policy_rows: DataFrame) -> DataFrame:
    """Positions at or below the reorder point, most expensive order first."""
    return policy_rows.filter("below_rop").orderBy(F.desc("suggested_order_cost"), *PAIR)


def order_summary(policy_rows: DataFrame) -> DataFrame:
    """Orders to place, their cost, and the share of positions whose reorder level is below the recommended point."""
    return policy_rows.agg(
        F.count_if(F.col("below_rop") & (F.col("suggested_order_qty") > 0)).alias("orders"),
        F.coalesce(F.sum(F.when(F.col("below_rop"), F.col("suggested_order_cost"))), F.lit(0)).alias("order_cost"),
        half_up(F.avg((F.col("policy_gap") > 0).cast("double")) * 100, 1).alias("level_too_low_pct"))


def at_risk(policy_rows: DataFrame, threshold: float = 50.0) -> DataFrame:
    return policy_rows.filter(F.col("stockout_risk_pct") >= threshold).orderBy(F.desc("stockout_risk_pct"), *PAIR)


def excess_stock(policy_rows: DataFrame) -> DataFrame:
    return policy_rows.filter(F.col("excess_value") > 0).orderBy(F.desc("excess_value"), *PAIR)


def excess_by_category(policy_rows: DataFrame) -> DataFrame:
    return policy_rows.groupBy("category").agg(F.sum("excess_value").alias("excess_value")).orderBy("excess_value", "category")


def risk_histogram(policy_rows: DataFrame, bins: int = 20) -> DataFrame:
    """Positions per equal band of stockout risk between 0 and 100 percent; empty bands are left out."""
    width = 100 / bins
    band = F.least(F.floor(F.col("stockout_risk_pct") / width), F.lit(bins - 1))
    return policy_rows.groupBy((band * width).alias("risk_from_pct")).agg(F.count("*").alias("positions"))
