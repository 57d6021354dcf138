"""Demand forecast (recent level x weekday profile x year-over-year ratio) and its holdout backtest.

Every term is a sum per product over a window of days, divided by a calendar day count. The windows (56 days, the holdout, and a
year ago) are read in one scan that opens their months only, and summed by product and day; the day x product matrix is never
built. The sums are staged, because the category pools and the products both start from them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import half_up, ratio
from shelfwise.functions.months import first_day, last_day, recent, within_any
from shelfwise.functions.staging import stage
from shelfwise.operators.demand import moving_average

# Window lengths of the model in days and the bounds of the seasonal ratio.
LEVEL_DAYS, PROFILE_DAYS, YEAR_DAYS = 28, 56, 365
RATIO_LOW, RATIO_HIGH = 0.6, 1.6
WEEK = range(7)


def _window_sums(sales: DataFrame, horizon: int, holdout: int) -> DataFrame:
    """Per product ever sold: units of the level window, of each weekday in the profile window, of last year's two windows, and a
    map of units by day of the holdout. History ends `holdout` days before the last order.

    Order lines are read for the windows only, in one scan, and summed by product and day first; what is known of a product beyond
    them is that it has been sold, which takes one column.
    """
    last = last_day(sales)
    start = F.date_sub(last, holdout - 1)                                  # the first day after history
    spans = [(F.date_sub(start, PROFILE_DAYS), last),
             (F.date_sub(start, YEAR_DAYS + LEVEL_DAYS), F.date_add(start, horizon - YEAR_DAYS - 1))]
    daily = within_any(sales, spans).groupBy("product_id", "order_date").agg(F.sum("quantity").alias("units"))
    daily = daily.select("product_id", "units", F.datediff("order_date", start).alias("at"), F.weekday("order_date").alias("weekday"))

    def total(condition: str, name: str) -> Column:
        return F.expr(f"sum(units) FILTER (WHERE {condition}) AS {name}")

    columns = [total(f"at < 0 AND at >= -{LEVEL_DAYS}", "level_units"),
               *[total(f"at < 0 AND at >= -{PROFILE_DAYS} AND weekday = {w}", f"weekday_{w}") for w in WEEK],
               total(f"at >= -{YEAR_DAYS} AND at < {horizon} - {YEAR_DAYS}", "year_ago_next"),
               total(f"at >= -{YEAR_DAYS} - {LEVEL_DAYS} AND at < -{YEAR_DAYS}", "year_ago_level")]
    names = ["level_units", *[f"weekday_{w}" for w in WEEK], "year_ago_next", "year_ago_level"]
    held = F.expr("map_from_entries(collect_list(struct(at, units)) FILTER (WHERE at >= 0)) AS held_out")
    sums = daily.groupBy("product_id").agg(*columns, *([held] if holdout else []))
    known = sales.select("product_id").distinct().join(sums, "product_id", "left").fillna(0, names)
    return known.withColumns({"history_days": F.datediff(last, first_day(sales)) + 1 - holdout, "next_day": start})


def _mean(name: str) -> str:
    """Mean over the weekdays that are present; null where it is zero."""
    units = " + ".join(f"coalesce({name}_{w}, 0D)" for w in WEEK)
    known = " + ".join(f"int({name}_{w} IS NOT NULL)" for w in WEEK)
    return f"nullif(try_divide({units}, {known}), 0D)"


def _with_factors(sums: DataFrame, horizon: int, products: DataFrame | None) -> DataFrame:
    """Add level, weekday profile (columns profile_0 .. profile_6, Monday first) and seasonal ratio."""
    p = sums.selectExpr(
        "*", f"try_divide(level_units, greatest(least(history_days, {LEVEL_DAYS}), 0)) AS level", f"least(history_days, {PROFILE_DAYS}) AS window_days")
    # days of each weekday in the profile window; a weekday that the window does not contain has no mean
    first = "weekday(date_sub(next_day, window_days))"
    days = [f"(window_days - 1 - pmod({w} - {first}, 7)) DIV 7 + 1" for w in WEEK]
    p = p.selectExpr("*", *[f"try_divide(double(weekday_{w}), {days[w]}) AS mean_{w}" for w in WEEK])

    if products is None:
        p = p.selectExpr("*", *[f"mean_{w} AS pooled_{w}" for w in WEEK],
                         "year_ago_next AS next_units", "year_ago_level AS base_units")
    else:
        p = p.selectExpr("*", f"{_mean('mean')} AS base")
        p = p.join(products.select("product_id", "category"), "product_id", "left")
        # a category is one row after the per-product sums: seven means and two totals
        pools = p.filter("category IS NOT NULL").groupBy("category").agg(
            *[F.expr(f"avg(mean_{w} / base) AS pooled_{w}") for w in WEEK],
            F.sum("year_ago_next").alias("next_units"), F.sum("year_ago_level").alias("base_units"))
        p = p.join(pools, "category", "left").fillna(1.0, [f"pooled_{w}" for w in WEEK])

    p = p.selectExpr("*", f"{_mean('pooled')} AS pooled_base",
                     f"try_divide(next_units / {horizon}D, base_units / {LEVEL_DAYS}D) AS year_ratio")
    season = (f"CASE WHEN history_days >= {YEAR_DAYS + LEVEL_DAYS} AND year_ratio IS NOT NULL "
              f"THEN least(greatest(year_ratio, {RATIO_LOW}D), {RATIO_HIGH}D) ELSE 1D END AS season")
    return p.selectExpr("*", season, *[f"coalesce(pooled_{w} / pooled_base, 1D) AS profile_{w}" for w in WEEK])


def _forecast_units(horizon: int) -> Column:
    """Array of `horizon` daily forecasts starting at `next_day`: the weekly pattern, repeated and cut to length."""
    week = ", ".join(f"level * season * profile_{w}" for w in WEEK)
    return F.expr(f"slice(flatten(array_repeat(array({week}), {horizon // 7 + 2})), weekday(next_day) + 1, {horizon})")


def forecast(sales: DataFrame, horizon: int = 30, products: DataFrame | None = None) -> DataFrame:
    """Daily demand forecast per product ever sold. `products` pools weekday profile and seasonal ratio per category."""
    factors = _with_factors(stage(_window_sums(sales, horizon, 0), "window-sums"), horizon, products)
    days = factors.select("product_id", "next_day", F.posexplode(_forecast_units(horizon)).alias("i", "units"))
    return days.select("product_id", F.date_add("next_day", F.col("i")).alias("day"), "units")


def _errors(sales: DataFrame, horizon: int, products: DataFrame | None) -> DataFrame:
    """Per product: units, forecast and absolute errors over the holdout, by day and by 7-day bucket from its first day."""
    f = _with_factors(stage(_window_sums(sales, horizon, horizon), "window-sums"), horizon, products)
    days = f"transform(sequence(0, {horizon - 1}), i -> double(coalesce(held_out[i], 0))) AS actual"
    f = f.select("product_id", F.expr(days), _forecast_units(horizon).alias("model"),
                 F.expr(f"array_repeat(level, {horizon}) AS naive"))

    def total(values: str) -> str:
        return f"aggregate({values}, 0D, (a, v) -> a + v)"

    def weekly(name: str) -> str:
        return f"transform(sequence(1, {horizon}, 7), s -> {total(f'slice({name}, s, 7)')})"

    def distance(a: str, b: str) -> str:
        return total(f"zip_with({a}, {b}, (x, y) -> abs(x - y))")

    f = f.selectExpr("*", *[f"{weekly(name)} AS weekly_{name}" for name in ("actual", "model", "naive")])
    return f.selectExpr(
        "product_id", f"{total('actual')} AS actual_units", f"{total('model')} AS model_units",
        f"{distance('actual', 'model')} AS model_error", f"{distance('actual', 'naive')} AS naive_error",
        f"{distance('weekly_actual', 'weekly_model')} AS weekly_model_error",
        f"{distance('weekly_actual', 'weekly_naive')} AS weekly_naive_error")


def backtest(sales: DataFrame, horizon: int = 30, products: DataFrame | None = None) -> DataFrame:
    """One row: daily and weekly WAPE of the model and of the flat recent level over the held-out days, and the bias."""
    e = _errors(sales, horizon, products)
    actual = F.sum("actual_units")

    def wape(error: str) -> Column:
        return half_up(ratio(F.sum(error), actual), 4)

    return e.agg(wape("model_error").alias("wape_model"), wape("naive_error").alias("wape_naive"),
                 wape("weekly_model_error").alias("wape_weekly_model"), wape("weekly_naive_error").alias("wape_weekly_naive"),
                 half_up(ratio(F.sum("model_units"), actual) - 1, 4).alias("bias_model"),
                 ).select(F.lit(horizon).alias("horizon_days"), "*")


def backtest_per_product(sales: DataFrame, horizon: int = 30, products: DataFrame | None = None) -> DataFrame:
    """Daily WAPE per product; null for a product that sold nothing in the holdout."""
    e = _errors(sales, horizon, products)
    return e.select("product_id", ratio(F.col("model_error"), F.col("actual_units")).alias("wape_model"),
                    ratio(F.col("naive_error"), F.col("actual_units")).alias("wape_naive"))


def smoothed_forecast(sales: DataFrame, horizon: int = 30, products: DataFrame | None = None) -> DataFrame:
    """The forecast with its 7-day average, which starts with the first day."""
    return moving_average(forecast(sales, horizon, products), 1)


def forecast_totals(sales: DataFrame, horizon: int = 30, products: DataFrame | None = None) -> DataFrame:
    """Forecast total per product, units of the last 30 days, and the change between the two."""
    past = recent(sales, 30).groupBy("product_id").agg(F.sum("quantity").alias("last_30_units"))
    ahead = forecast(sales, horizon, products).groupBy("product_id").agg(F.sum("units").alias("forecast_units"))
    change = ratio(F.col("forecast_units"), F.greatest(F.col("last_30_units"), F.lit(1))) - 1
    return ahead.join(past, "product_id", "left").fillna(0, ["last_30_units"]).select(
        "product_id", half_up(F.col("forecast_units"), 1).alias("forecast_units"), "last_30_units",
        half_up(change, 4).alias("change"))


def enough_history(sales: DataFrame, days: int = 90) -> DataFrame:
    """Distinct sale days, and whether they are enough to check the model."""
    return sales.agg(F.count_distinct("order_date").alias("sale_days")).withColumn("can_check", F.col("sale_days") > days)


def require_product(products: DataFrame, product_id: str) -> None:
    if products.filter(F.col("product_id") == product_id).isEmpty():
        raise LookupError(f"unknown product {product_id}")


def product_forecast(sales: DataFrame, products: DataFrame, product_id: str, horizon: int = 30) -> DataFrame:
    """Daily forecast of one product with the total; profile and ratio still come from its whole category."""
    if not 7 <= horizon <= 90:
        raise ValueError("horizon must be between 7 and 90 days")
    require_product(products, product_id)
    f = forecast(sales, horizon, products).filter(F.col("product_id") == product_id)
    total = f.agg(F.sum("units")).scalar()
    return f.select("product_id", "day", half_up(F.col("units"), 2).alias("units"),
                    half_up(total, 1).alias("total_units")).orderBy("day")
