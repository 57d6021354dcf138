"""ABC (value) and XYZ (demand variability) segments."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import half_up, ratio
from shelfwise.functions.ordering import running_totals


@dataclass(frozen=True)
class Cuts:
    """Shares of revenue that close class A and B; coefficients of variation that close class X and Y."""

    a: float = 0.80
    b: float = 0.95
    x: float = 0.25
    y: float = 0.50


def _month(day: str = "order_date") -> Column:
    return F.trunc(day, "MM")


def kept_months(sales: DataFrame) -> Column:
    """Sorted array of the months that count, as a scalar subquery: the full calendar months, or all when fewer than three are full.

    Only months in which anything sold can count; the array is bounded by the calendar.
    """
    days = sales.groupBy("order_date").agg(F.lit(1).alias("_one"))
    span = days.agg(F.collect_set(_month()).alias("months"), F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    full = F.filter("months", lambda m: (m >= F.col("lo")) & (F.last_day(m) <= F.col("hi")))
    return span.select(F.sort_array(F.when(F.size(full) >= 3, full).otherwise(F.col("months")))).scalar()


def _product_months(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_id", _month().alias("month")).agg(
        F.sum("quantity").alias("units"), F.sum("revenue").alias("revenue"))


def _rate() -> Column:
    return F.col("units") / F.day(F.last_day("month")).cast("double")


def monthly_daily_rate(sales: DataFrame) -> DataFrame:
    """Mean units per day of every product in every month that counts, zero where it did not sell."""
    months = kept_months(sales)
    sold = _product_months(sales).select("product_id", F.struct("month", _rate().alias("rate")).alias("entry"))
    # one entry per month: bounded by the calendar
    known = sold.groupBy("product_id").agg(F.map_from_entries(F.collect_list("entry")).alias("rates"))
    grid = known.select("product_id", "rates", F.explode(months).alias("month"))
    return grid.select("product_id", "month", F.coalesce(F.try_element_at("rates", F.col("month")), F.lit(0.0)).alias("units_per_day"))


def demand_variation(sales: DataFrame) -> DataFrame:
    """Revenue and population coefficient of variation of the monthly rate per product, months without sales included.

    The zero months are folded in by formula (pooled variance of the months sold and of M - n zeros) instead of being built.
    """
    months = kept_months(sales)
    counts = F.array_contains(months, F.col("month"))
    rate = F.when(counts, _rate())
    per = _product_months(sales).groupBy("product_id").agg(
        F.sum("revenue").alias("revenue"), F.count(rate).alias("n"), F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    size = F.size(months)
    mean = F.col("m") * F.col("n") / size
    spread = (F.col("n") * F.col("v") + F.col("m") * F.col("m") * F.col("n") * (size - F.col("n")) / size) / size
    return per.select("product_id", "revenue", ratio(F.sqrt(spread), mean).alias("cv"))


def abc_xyz(sales: DataFrame, products: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """Value class by the revenue share before the product, variability class by the monthly coefficient of variation."""
    order = [F.col("revenue").desc(), F.col("product_id").asc()]
    ranked = running_totals(demand_variation(sales), order, {"upto": F.col("revenue")}, "abc")
    total = F.col("upto_total")
    before = ratio(F.col("upto") - F.col("revenue"), total)
    abc = F.when(before < cuts.a, "A").when(before < cuts.b, "B").otherwise("C")
    xyz = F.when(F.col("cv") <= cuts.x, "X").when(F.col("cv") <= cuts.y, "Y").otherwise("Z")
    classed = ranked.select(
        "product_id", "revenue", half_up(ratio(F.col("revenue") * 100, total), 2).alias("revenue_share_pct"),
        half_up(ratio(F.col("upto") * 100, total), 2).alias("cum_share_pct"), abc.alias("abc"),
        half_up(F.col("cv"), 3).alias("demand_cv"), xyz.alias("xyz"), F.concat(abc, xyz).alias("segment"))
    return classed.join(products.select("product_id", "product_name", "category"), "product_id")


def segment_summary(segments: DataFrame) -> DataFrame:
    """Products and revenue per segment."""
    return segments.groupBy("segment").agg(F.count("*").alias("products"), F.sum("revenue").alias("revenue"))
