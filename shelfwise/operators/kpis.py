"""Headline KPIs, monthly sales, turnover and movement classes, reorder alerts, category and warehouse summaries.

Facts are always aggregated on their keys before they meet a dimension, so a hot product or warehouse is combined map-side
and no join carries raw order lines.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import half_up, positive, ratio
from shelfwise.functions.months import LAST_DAY, recent, within
from shelfwise.functions.ordering import rows_at, select_places
from shelfwise.functions.staging import stage
from shelfwise.schemas import PAIR

# Severity bands in days of stock left.
STOCKOUT_DAYS, CRITICAL_DAYS = 0, 3


def is_low() -> Column:
    return F.col("current_stock") <= F.col("reorder_level")


# ------------------------------------------------------------------------------------------------ headline, months
def headline(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: total sales, units sold, total stock, low-stock items."""
    sold = sales.agg(F.struct(F.sum("revenue").alias("total_sales"), F.sum("quantity").alias("units_sold"))).scalar()
    stock = inventory.agg(F.sum("current_stock").alias("total_stock"), F.count_if(is_low()).alias("low_stock_items"))
    return stock.select(sold["total_sales"].alias("total_sales"), sold["units_sold"].alias("units_sold"),
                        "total_stock", "low_stock_items")


def sales_headline(sales: DataFrame) -> DataFrame:
    """Headline for data without stock."""
    return sales.agg(F.sum("revenue").alias("total_sales"), F.sum("quantity").alias("units_sold"),
                     F.count_distinct("product_id").alias("skus_sold"))


def monthly_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.trunc("order_date", "MM").alias("month")).agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("units"))


def monthly_sales(sales: DataFrame) -> DataFrame:
    """Revenue and units per month, growth against the previous month that has sales."""
    before = F.lag("revenue").over(Window.orderBy("month"))          # one row per month: bounded by the calendar
    growth = ratio((F.col("revenue") - before) * 100, before)
    return monthly_totals(sales).withColumn("mom_growth_pct", half_up(growth, 1))


# ------------------------------------------------------------------------------------------------ turnover
def sold_per_pair(sales: DataFrame) -> DataFrame:
    """Units, revenue and days from the first to the last order of every pair, over order lines or their sums by month."""
    last = LAST_DAY if LAST_DAY in sales.columns else "order_date"
    return sales.groupBy(*PAIR).agg(
        F.sum("quantity").alias("units_sold"), F.sum("revenue").alias("revenue"),
        (F.datediff(F.max(last), F.min("order_date")) + 1).alias("days_selling"))


def opening_stock(restocks: DataFrame) -> DataFrame:
    """Quantity of the first receipt of every pair; the smaller one when two arrive on the same day."""
    arrival = F.unix_date("restock_date").cast("bigint") * F.lit(2**32) + F.col("quantity")
    return restocks.groupBy(*PAIR).agg(F.min_by("quantity", arrival).alias("opening_stock"))


def quartile_labels(df: DataFrame, keys: list[str], nulls_first: bool = False) -> DataFrame:
    """Add movement_class: Fast and Slow for the first and the last of four equal tiles by turnover, largest first, Medium between.

    The two border values are selected, not sorted for; a class is then a comparison with them. Only the rows of a value that a border
    runs through are put in order, by key. Rows without turnover are left `n/a`, or come first if so asked.
    """
    value = F.col("stock_turnover").cast("double")
    value = F.coalesce(value, F.lit(float("inf"))) if nulls_first else value

    def size(n: int) -> tuple[int, int]:
        """Rows of the first and of the last tile: the first tiles take what is left over."""
        return n // 4 + min(n % 4, 1), n // 4

    n, border = select_places(df, value, {"Fast": 0.75, "Slow": 0.25}, lambda n: {"Fast": n - size(n)[0], "Slow": size(n)[1] - 1})
    # of the rows with a border's value, so many come first, in the order of their keys, to the upper side of the border
    upper = {name: {"Fast": size(n)[0], "Slow": n - size(n)[1]}[name] - (n - b.before - b.ties) for name, b in border.items()}
    split = {name: b for name, b in border.items() if 0 < upper[name] < b.ties}
    last_key = {}
    if split:
        values = sorted({b.value for b in split.values()}, reverse=True)
        order = [F.col("_value").desc(), *[F.col(k).asc() for k in keys]]
        tied = df.select(*keys, value.alias("_value")).filter(F.col("_value").isin(values))
        rows_of = {b.value: b.ties for b in split.values()}
        at = {name: sum(rows_of[v] for v in values if v > b.value) + upper[name] for name, b in split.items()}
        found = rows_at(tied, order, list(at.values()), sum(rows_of.values()), "turnover-border")
        last_key = {name: F.struct(*[F.lit(found[place][k]).alias(k) for k in keys]) for name, place in at.items()}

    def above(name: str) -> Column:
        """Whether a row is on the upper side of the border of a class."""
        if name not in border:
            return F.lit(name == "Slow")
        tie = F.struct(*keys) <= last_key[name] if name in last_key else F.lit(upper[name] > 0)
        return (value > border[name].value) | ((value == border[name].value) & tie)

    label = F.when(value.isNull(), "n/a").when(above("Fast"), "Fast").when(above("Slow"), "Medium").otherwise("Slow")
    return df.withColumn("movement_class", label)


def movement_classes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fast / Medium / Slow by quartile of turnover over the rows that have one, `n/a` for the others."""
    return quartile_labels(stage(df, "turnover"), keys)


def turnover_base(sales: DataFrame, inventory: DataFrame, restocks: DataFrame, products: DataFrame,
                  level: str = "warehouse_product") -> DataFrame:
    """Turnover figures without the movement class."""
    if level not in ("warehouse_product", "product"):
        raise ValueError(f"unknown level {level!r}")
    receipts = restocks.limit(1).agg(F.count("*")).scalar()
    opening = F.when(receipts > 0, F.col("opening_stock")).otherwise(F.col("current_stock"))
    k = (inventory.join(sold_per_pair(sales), PAIR, "left").join(opening_stock(restocks), PAIR, "left")
         .select(*PAIR, "current_stock", "reorder_level", F.coalesce("units_sold", F.lit(0)).alias("units_sold"),
                 F.coalesce("revenue", F.lit(0)).alias("revenue"), opening.alias("opening_stock"), "days_selling"))
    if level == "product":
        k = k.groupBy("product_id").agg(
            F.sum("current_stock").alias("current_stock"), F.sum("reorder_level").alias("reorder_level"),
            F.sum("units_sold").alias("units_sold"), F.sum("revenue").alias("revenue"),
            F.coalesce(F.sum("opening_stock"), F.lit(0)).alias("opening_stock"),
            F.max("days_selling").alias("days_selling"))
    named = k.join(products.select("product_id", "product_name", "category"), "product_id")
    average = named.withColumn("avg_stock", (F.col("opening_stock") + F.col("current_stock")) / F.lit(2.0))
    turned = average.withColumn("stock_turnover", half_up(ratio(F.col("units_sold"), positive(F.col("avg_stock"))), 2))
    days = half_up(ratio(F.col("days_selling"), positive(F.col("stock_turnover"))), 0)
    return turned.withColumn("days_of_inventory", days)


def stock_turnover(sales: DataFrame, inventory: DataFrame, restocks: DataFrame, products: DataFrame,
                   level: str = "warehouse_product") -> DataFrame:
    """Units sold over average stock, days of inventory and movement class, per pair or per product.

    Average stock is the mean of opening and current stock; without any receipts the current stock stands for both.
    """
    keys = ["product_id"] if level == "product" else PAIR
    return movement_classes(turnover_base(sales, inventory, restocks, products, level), keys)


def stock_turnover_view(sales: DataFrame, inventory: DataFrame, restocks: DataFrame, products: DataFrame) -> DataFrame:
    """The reporting view: only pairs with both sales and receipts, days from the unrounded turnover."""
    stocked = restocks.groupBy(*PAIR).agg(
        F.sum("quantity").alias("units_restocked"), (F.count("*") - 1).alias("restock_events"),
        F.min_by("quantity", F.unix_date("restock_date").cast("bigint") * F.lit(2**32) + F.col("quantity")).alias("opening_stock"))
    k = (inventory.join(sold_per_pair(sales), PAIR).join(stocked, PAIR)
         .join(products.select("product_id", "product_name", "category"), "product_id"))
    average = (F.col("opening_stock") + F.col("current_stock")) / F.lit(2.0)
    turnover = ratio(F.col("units_sold"), average)
    return k.select(*PAIR, "product_name", "category", "current_stock", "reorder_level", "units_sold", "units_restocked",
                    "restock_events", half_up(average, 1).alias("avg_stock"), half_up(turnover, 2).alias("stock_turnover"),
                    half_up(ratio(F.col("days_selling"), turnover), 0).alias("days_of_inventory"))


def stock_turnover_classified(sales: DataFrame, inventory: DataFrame, restocks: DataFrame, products: DataFrame) -> DataFrame:
    """The reporting view with its quartile classes."""
    return quartile_labels(stage(stock_turnover_view(sales, inventory, restocks, products), "turnover"), PAIR, nulls_first=True)


# ------------------------------------------------------------------------------------------------ alerts
def _alert_rows(sales: DataFrame, inventory: DataFrame, products: DataFrame, warehouses: DataFrame, window_days: int) -> DataFrame:
    demand = (recent(sales, window_days).groupBy(*PAIR)
              .agg((F.sum("quantity") / F.lit(float(window_days))).alias("daily_demand")))
    return (inventory.filter(is_low())
            .join(products.select("product_id", "product_name", "category", "lead_time_days"), "product_id")
            .join(warehouses.select("warehouse_id", "warehouse_name"), "warehouse_id")
            .join(demand, PAIR, "left")
            .withColumn("shortfall", F.col("reorder_level") - F.col("current_stock"))
            .withColumn("days_of_stock_left", half_up(ratio(F.col("current_stock"), F.col("daily_demand")), 1)))


def by_urgency() -> list[Column]:
    return [F.asc_nulls_last("days_of_stock_left"), F.desc("shortfall"), F.asc("warehouse_id"), F.asc("product_id")]


def severity(days_left: Column) -> Column:
    return (F.when(days_left <= STOCKOUT_DAYS, "Stockout").when(days_left <= CRITICAL_DAYS, "Critical").otherwise("Low"))


def reorder_alerts(sales: DataFrame, inventory: DataFrame, products: DataFrame, warehouses: DataFrame,
                   window_days: int = 90) -> DataFrame:
    """Pairs at or below their reorder level, most urgent first, with days of stock left at the recent sales rate."""
    rows = _alert_rows(sales, inventory, products, warehouses, window_days)
    return rows.withColumn("severity", severity(F.col("days_of_stock_left"))).orderBy(*by_urgency())


def reorder_alerts_view(sales: DataFrame, inventory: DataFrame, products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """The reporting view: last 90 days, demand with two decimals, no severity."""
    rows = _alert_rows(sales, inventory, products, warehouses, 90)
    return rows.withColumn("daily_demand", half_up(F.col("daily_demand"), 2))


# ------------------------------------------------------------------------------------------------ summaries
def sold_per_product(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_id").agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("units"))


def category_totals(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue and gross profit per category; profit follows from the per-product sums."""
    j = sold_per_product(sales).join(products.select("product_id", "category", "unit_cost"), "product_id")
    return j.groupBy("category").agg(
        F.sum("revenue").alias("revenue"), F.sum(F.col("revenue") - F.col("units") * F.col("unit_cost")).alias("gross_profit"))


def category_summary(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, gross profit, margin and share of revenue per category, largest first."""
    c = category_totals(sales, products)
    # the total sums both columns, so that its plan equals the one of the rows and the shuffled sums are reused
    everything = c.agg(F.struct(F.sum("revenue").alias("revenue"), F.sum("gross_profit").alias("profit"))).scalar()["revenue"]
    return c.select("category", "revenue", "gross_profit",
                    half_up(ratio(F.col("gross_profit") * 100, F.col("revenue")), 1).alias("margin_pct"),
                    half_up(ratio(F.col("revenue") * 100, everything), 1).alias("revenue_share_pct"),
                    ).orderBy(F.desc("revenue"), "category")


def _warehouse_rows(sales: DataFrame, inventory: DataFrame, warehouses: DataFrame) -> DataFrame:
    sold = sales.groupBy("warehouse_id").agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("units"))
    held = inventory.groupBy("warehouse_id").agg(
        F.sum("current_stock").alias("total_stock"), F.count("*").alias("skus"),
        F.count_if(is_low()).alias("low_stock_items"))
    return warehouses.join(sold, "warehouse_id", "left").join(held, "warehouse_id", "left")


def warehouse_summary(sales: DataFrame, inventory: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Sales and stock per warehouse, zero where there is none, largest revenue first."""
    rows = _warehouse_rows(sales, inventory, warehouses)
    numbers = ["revenue", "units", "total_stock", "skus", "low_stock_items"]
    return rows.fillna(0, numbers).orderBy(F.desc("revenue"), "warehouse_id")


def warehouse_summary_view(sales: DataFrame, inventory: DataFrame, warehouses: DataFrame) -> DataFrame:
    """The reporting view: stock columns stay null for a warehouse without stock rows."""
    return _warehouse_rows(sales, inventory, warehouses).fillna(0, ["revenue", "units"])


# ------------------------------------------------------------------------------------------------ analysis queries
def top_products(sales: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """The n products with the largest revenue."""
    j = sold_per_product(sales).withColumnRenamed("units", "units_sold")
    named = j.join(products.select("product_id", "product_name", "category"), "product_id")
    return (named.select("product_id", "product_name", "category", "units_sold", "revenue")
            .orderBy(F.desc("revenue"), "product_id").limit(n))


def top_product_ids(sales: DataFrame, n: int = 10) -> DataFrame:
    return (sales.groupBy("product_id").agg(F.sum("revenue").alias("revenue"))
            .orderBy(F.desc("revenue"), "product_id").limit(n))


def slowest_pairs(sales: DataFrame, inventory: DataFrame, restocks: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """The n pairs with the lowest turnover: capital tied up."""
    c = stock_turnover_classified(sales, inventory, restocks, products)
    return (c.orderBy(F.asc_nulls_last("stock_turnover"), *PAIR).limit(n)
            .select("warehouse_id", "product_id", "product_name", "current_stock", "stock_turnover", "days_of_inventory",
                    "movement_class"))


def category_performance(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Whole-unit revenue with share and margin per category."""
    c = category_summary(sales, products)
    return c.select("category", F.round("revenue", 0).alias("revenue"), "revenue_share_pct", "margin_pct")


def warehouse_month(sales: DataFrame, warehouse_id: str, year: int, month: int) -> DataFrame:
    """Revenue of one warehouse in one month."""
    start = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    lines = within(sales, start, F.last_day(start)).filter(F.col("warehouse_id") == warehouse_id)
    return lines.agg(F.sum("revenue").alias("revenue"))


def product_days(sales: DataFrame, product_id: str) -> DataFrame:
    """Units per day of one product."""
    return (sales.filter(F.col("product_id") == product_id).groupBy("order_date")
            .agg(F.sum("quantity").alias("units")).orderBy("order_date"))


def load_check(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Row counts after a load and the rows whose revenue is not quantity times price."""
    wrong = F.col("revenue") != F.round(F.col("quantity") * F.col("unit_price"), 2)
    s = sales.agg(F.count("*").alias("sales_rows"), F.count_if(wrong).alias("bad_revenue_rows"))
    held = inventory.agg(F.count("*")).scalar()
    return s.withColumn("inventory_rows", held)
