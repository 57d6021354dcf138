"""Star-schema measures: named aggregates over sales, stock and receipts, evaluated per group of dimension columns.

Facts are summed per (warehouse, product, month) keys first; only these sums meet the dimensions.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import ratio
from shelfwise.functions.months import within
from shelfwise.functions.ordering import quantiles, running_totals, skip_rank
from shelfwise.functions.staging import stage
from shelfwise.operators.kpis import is_low
from shelfwise.schemas import PAIR, Tables

DIMENSION_COLUMNS = {
    "warehouse_id": "warehouses", "warehouse_name": "warehouses", "region": "warehouses",
    "product_id": "products", "product_name": "products", "category": "products", "lead_time_days": "products",
    "year": "dates", "month": "dates", "month_sort": "dates", "date": "dates",
}
SALES_MEASURES = ("total_sales", "units_sold", "gross_profit", "gross_margin", "sales_ly", "sales_yoy", "revenue_rank")
STOCK_MEASURES = ("total_stock", "low_stock_items", "opening_stock", "average_stock", "stock_turnover", "days_in_period",
                  "days_of_inventory", "reorder_status", "shortfall", "movement_class")


@dataclass(frozen=True)
class Filters:
    """Slicer choices; None means everything."""

    warehouses: list[str] | None = None
    categories: list[str] | None = None
    first_day: str | None = None
    last_day: str | None = None


def date_columns(day: Column) -> dict[str, Column]:
    return {"date": day, "year": F.year(day), "month_no": F.month(day), "month": F.date_format(day, "MMM yyyy"),
            "month_sort": F.year(day) * 100 + F.month(day)}


def dim_date(sales: DataFrame) -> DataFrame:
    """Calendar from the first to the last order day, one row per day."""
    bounds = sales.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.select(*[c.alias(n) for n, c in date_columns(F.col("day")).items()])


def filter_tables(t: Tables, filters: Filters) -> Tables:
    """Restrict facts and dimensions to the chosen warehouses, categories and order dates."""
    sales, inventory, restocks, products, warehouses = t.sales, t.inventory, t.restocks, t.products, t.warehouses
    if filters.categories is not None:
        products = products.filter(F.col("category").isin(filters.categories))
        ids = products.select("product_id")
        sales, inventory, restocks = (f.join(ids, "product_id", "left_semi") for f in (sales, inventory, restocks))
    if filters.warehouses is not None:
        chosen = F.col("warehouse_id").isin(filters.warehouses)
        sales, inventory, restocks, warehouses = (f.filter(chosen) for f in (sales, inventory, restocks, warehouses))
    first, last = (F.lit(d).cast("date") if d is not None else None for d in (filters.first_day, filters.last_day))
    sales = within(sales, first, last)
    return Tables(warehouses, products, inventory, restocks, sales)


def _with_dimensions(facts: DataFrame, t: Tables, by: list[str]) -> DataFrame:
    """Attach the requested product and warehouse columns to pre-aggregated facts."""
    for table, key in (("products", "product_id"), ("warehouses", "warehouse_id")):
        wanted = [c for c in by if DIMENSION_COLUMNS[c] == table and c not in facts.columns]
        if wanted:
            facts = facts.join(getattr(t, table).select(key, *wanted), key)
    return facts


def _dates_of(by: list[str]) -> list[str]:
    return [c for c in by if DIMENSION_COLUMNS[c] == "dates"]


def sales_by(t: Tables, by: list[str]) -> DataFrame:
    """Total sales, units sold, gross profit and gross margin per group."""
    dates = _dates_of(by)
    keys = [*PAIR, *dates]
    columns = date_columns(F.col("order_date"))
    per = t.sales.withColumns({c: columns[c] for c in dates}).groupBy(*keys).agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("units"))
    costed = _with_dimensions(per, t, by).join(t.products.select("product_id", "unit_cost"), "product_id")
    profit = F.sum(F.col("revenue") - F.col("units") * F.col("unit_cost"))
    g = costed.groupBy(*by).agg(F.sum("revenue").alias("total_sales"), F.sum("units").alias("units_sold"), profit.alias("gross_profit"))
    return g.withColumn("gross_margin", ratio(F.col("gross_profit"), F.col("total_sales")))


#: Period columns by the finest date column asked for.
GRAINS = {"date": "day", "month": "month", "month_sort": "month", "year": "year"}


def _start_of(day: Column, grain: str) -> Column:
    return {"day": day, "month": F.trunc(day, "MM"), "year": F.trunc(day, "YYYY")}[grain]


def sales_last_year(t: Tables, by: list[str], grain: str = "month", first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Sales, sales one year before, and the change, per group and day, month or year.

    The year is taken off the dates, not off the periods: `first_day` and `last_day` limit the dates of this year, so `t` must
    still hold the year before. Days outside the sales history are no dates. A group that sold last year only has a row.
    29 February has no counterpart at day grain and falls into its month otherwise.
    """
    history = t.sales.agg(F.struct(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))).scalar()
    chosen = [F.col("day").between(history["lo"], history["hi"])]
    chosen += [F.col("day") >= F.lit(first_day).cast("date")] if first_day else []
    chosen += [F.col("day") <= F.lit(last_day).cast("date")] if last_day else []
    day = F.col("order_date")
    leap_day = (F.month(day) == 2) & (F.day(day) == 29)
    earlier = t.sales.filter(~leap_day) if grain == "day" else t.sales

    def summed(sales: DataFrame, shifted: Column, name: str) -> DataFrame:
        dated = sales.withColumn("day", shifted)
        for condition in chosen:
            dated = dated.filter(condition)
        per = dated.groupBy(*PAIR, _start_of(F.col("day"), grain).alias("period")).agg(F.sum("revenue").alias("revenue"))
        return _with_dimensions(per, t, by).groupBy(*by, "period").agg(F.sum("revenue").alias(name))

    now, then = summed(t.sales, day, "total_sales"), summed(earlier, F.add_months(day, 12), "sales_ly")
    both = now.join(then, [*by, "period"], "full")
    change = F.coalesce("total_sales", F.lit(0)) - F.col("sales_ly")
    return both.withColumn("sales_yoy", ratio(change, F.col("sales_ly")))


def revenue_rank(t: Tables, everything: Tables | None = None) -> DataFrame:
    """Skip ranking of all product names by total sales; `everything` has the products that a product filter leaves out."""
    by_name = sales_by(everything or t, ["product_name"]).select("product_name", "total_sales")
    ranked = skip_rank(by_name, "total_sales", "revenue_rank")
    if everything is None:
        return ranked
    return ranked.join(t.products.select("product_name").distinct(), "product_name", "left_semi")


def revenue_rank_by(t: Tables, by: list[str], everything: Tables) -> DataFrame:
    """Per group, one more than the number of product names that sold more than the group."""
    names = stage(sales_by(everything, ["product_name"]).select(F.col("total_sales").alias("_sold")), "names-sold")
    groups = sales_by(t, by).select(*by, "total_sales")
    counts = names.groupBy("_sold").agg(F.count("*").alias("_names"))
    # names and groups in one descending line: names above a group are the running count before it
    line = (counts.select(F.col("_sold").alias("total_sales"), "_names").unionByName(
        groups.select("total_sales").distinct().withColumn("_names", F.lit(0).cast("bigint"))))
    line = line.groupBy("total_sales").agg(F.sum("_names").alias("_names"))
    upto = running_totals(line, [F.col("total_sales").desc()], {"_upto": F.col("_names")}, "ranked-groups")
    above = upto.select("total_sales", (F.col("_upto") - F.col("_names") + 1).alias("revenue_rank"))
    return groups.join(above, "total_sales").select(*by, "total_sales", "revenue_rank")


def first_receipt_day(restocks: DataFrame) -> Column:
    return restocks.agg(F.min("restock_date")).scalar()


def days_in_period(sales: DataFrame) -> Column:
    """Length of the whole sales history in days, whatever the filters."""
    return sales.agg(F.datediff(F.max("order_date"), F.min("order_date")) + 1).scalar()


def stock_by(t: Tables, by: list[str], everything: Tables | None = None) -> DataFrame:
    """All stock measures per group of product and warehouse columns.

    Opening stock counts the receipts of the first receipt day of the unfiltered table; `everything` is that table set.
    """
    whole = everything or t
    held = t.inventory.groupBy(*PAIR).agg(
        F.sum("current_stock").alias("total_stock"), F.sum("reorder_level").alias("reorder_level"),
        F.count_if(is_low()).alias("low"))
    opened = (t.restocks.filter(F.col("restock_date") == first_receipt_day(whole.restocks))
              .groupBy(*PAIR).agg(F.sum("quantity").alias("opening_stock")))
    sold = t.sales.groupBy(*PAIR).agg(F.sum("quantity").alias("units_sold"))
    pairs = held.join(opened, PAIR, "full").join(sold, PAIR, "full")
    c = F.col
    g = _with_dimensions(pairs, t, by).groupBy(*by).agg(
        *[F.sum(n).alias(n) for n in ("total_stock", "reorder_level", "opening_stock", "units_sold")],
        F.nullif(F.sum("low"), F.lit(0)).alias("low_stock_items"))
    average = (F.coalesce("opening_stock", F.lit(0)) + F.coalesce("total_stock", F.lit(0))) / F.lit(2.0)
    known = c("opening_stock").isNotNull() | c("total_stock").isNotNull()
    g = g.withColumn("average_stock", F.when(known, average))
    g = g.withColumn("stock_turnover", ratio(c("units_sold"), c("average_stock")))
    g = g.withColumn("days_in_period", days_in_period(whole.sales))
    short = F.coalesce("total_stock", F.lit(0)) <= F.coalesce("reorder_level", F.lit(0))
    return g.withColumns({
        "days_of_inventory": ratio(c("days_in_period"), c("stock_turnover")),
        "reorder_status": F.when(short, "REORDER").otherwise("OK"),
        "shortfall": F.greatest(F.lit(0), F.coalesce("reorder_level", F.lit(0)) - F.coalesce("total_stock", F.lit(0)))})


def movement_class(t: Tables, everything: Tables | None = None) -> DataFrame:
    """Fast, Medium or Slow per product by the inclusive quartiles of product turnover.

    The quartiles are over `everything`: the tables without filters on products.
    """
    whole = everything or t
    per = stage(stock_by(whole, ["product_id"]).select("product_id", "stock_turnover"), "turnover")
    quartiles = quantiles(per, [], "stock_turnover", {"p75": 0.75, "p25": 0.25})
    cuts = quartiles.agg(F.struct(F.max("p75").alias("p75"), F.max("p25").alias("p25"))).scalar()
    turnover = F.coalesce("stock_turnover", F.lit(0.0))           # a blank compares as zero
    label = F.when(turnover >= cuts["p75"], "Fast").when(turnover <= cuts["p25"], "Slow").otherwise("Medium")
    chosen = per if everything is None else per.join(t.products.select("product_id"), "product_id", "left_semi")
    return chosen.withColumn("movement_class", label)


def measure(t: Tables, name: str, by: list[str], filters: Filters = Filters()) -> DataFrame:
    """One named measure per group: columns `by` plus the measure.

    Rank and movement quartiles ignore filters on products; opening day and period length ignore all filters on their table.
    """
    unknown = [c for c in by if c not in DIMENSION_COLUMNS]
    if unknown:
        raise KeyError(f"unknown dimension columns {unknown}")
    chosen, dates = filter_tables(t, filters), _dates_of(by)
    all_products = filter_tables(t, replace(filters, categories=None))
    if name in ("total_sales", "units_sold", "gross_profit", "gross_margin"):
        return sales_by(chosen, by).select(*by, name)
    if name in ("sales_ly", "sales_yoy"):
        if not dates:
            raise ValueError(f"{name} needs a date column: a year, a month or a date")
        all_days = filter_tables(t, replace(filters, first_day=None, last_day=None))
        grain = next(g for g in ("day", "month", "year") if g in [GRAINS[c] for c in dates])
        rows = sales_last_year(all_days, [c for c in by if c not in dates], grain, filters.first_day, filters.last_day)
        columns = date_columns(F.col("period"))
        return rows.select(*[columns[c].alias(c) if c in dates else c for c in by], name)
    if name == "revenue_rank":
        if by == ["product_name"]:
            return revenue_rank(chosen, all_products).select(*by, name)
        return revenue_rank_by(chosen, by, all_products).select(*by, name)
    if name in STOCK_MEASURES and dates:
        raise ValueError(f"{name} is a measure of stock as it is now: it has no value by {', '.join(dates)}")
    if name == "movement_class":
        if by != ["product_id"]:
            raise ValueError("movement_class is a measure of products: group by product_id")
        return movement_class(chosen, all_products).select(*by, name)
    if name in STOCK_MEASURES:
        return stock_by(chosen, by, everything=t).select(*by, name)
    raise KeyError(f"unknown measure {name!r}")


# ------------------------------------------------------------------------------------------------ report visuals
def turnover_extremes(t: Tables, n: int = 10) -> DataFrame:
    """The n product names with the highest and the n with the lowest turnover."""
    per = stage(stock_by(t, ["product_name"]).select("product_name", "stock_turnover").filter("stock_turnover IS NOT NULL"), "turnover")
    top = per.orderBy(F.desc("stock_turnover"), "product_name").limit(n).withColumn("side", F.lit("fastest"))
    bottom = per.orderBy(F.asc("stock_turnover"), "product_name").limit(n).withColumn("side", F.lit("slowest"))
    return top.unionByName(bottom)


def reorder_table(t: Tables) -> DataFrame:
    """Warehouse and product names that need a reorder, with summed stock, level, shortfall and the longest lead time."""
    rows = (t.inventory.join(t.products.select("product_id", "product_name", "lead_time_days"), "product_id")
            .join(t.warehouses.select("warehouse_id", "warehouse_name"), "warehouse_id"))
    g = rows.groupBy("warehouse_name", "product_name").agg(
        F.sum("current_stock").alias("current_stock"), F.sum("reorder_level").alias("reorder_level"),
        F.max("lead_time_days").alias("lead_time_days"))
    due = g.filter(F.col("current_stock") <= F.col("reorder_level"))
    return due.withColumn("shortfall", F.greatest(F.lit(0), F.col("reorder_level") - F.col("current_stock")))
