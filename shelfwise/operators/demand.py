"""Daily demand: the dense calendar form and its statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.months import first_day, last_day, within
from shelfwise.schemas import PAIR


def day_count(sales: DataFrame) -> Column:
    return F.datediff(last_day(sales), first_day(sales)) + 1


def product_days(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_id", F.col("order_date").alias("day")).agg(F.sum("quantity").alias("units"))


def _zero_filled(sales: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per product and calendar day between two dates; every row fills the days up to the product's next one, nothing is joined.

    Only days with a sale and one row per product are shuffled, the matrix is not: it lies by product, so sums per product need no shuffle.
    """
    every = sales.select("product_id").distinct().select("product_id", F.lit(None).cast("date").alias("sold"), F.lit(None).cast("bigint").alias("units"))
    rows = every.unionByName(product_days(within(sales, first, last)).select("product_id", F.col("day").alias("sold"), "units"))
    # a product has one row per day and the dateless one, which comes first and fills the days before the first sale
    days = Window.partitionBy("product_id").orderBy("sold")
    start, end = F.coalesce("sold", first), F.coalesce(F.date_sub(F.lead("sold").over(days), 1), last)
    spans = rows.select("product_id", "sold", "units", start.alias("start"), end.alias("end")).filter(F.col("start") <= F.col("end"))
    filled = spans.select("product_id", "sold", "units", F.explode(F.sequence("start", "end")).alias("day"))
    # a null product stands for no product: its days are there, its units are not
    of_day = (F.col("day") == F.col("sold")) & F.col("product_id").isNotNull()
    return filled.select("product_id", "day", F.coalesce(F.when(of_day, F.col("units")), F.lit(0)).alias("units"))


def daily_matrix(sales: DataFrame) -> DataFrame:
    """Units per product and day over the full calendar, zero filled, in long form."""
    return _zero_filled(sales, first_day(sales), last_day(sales))


def recent_history(sales: DataFrame, days: int = 120) -> DataFrame:
    """The last `days` rows of the daily matrix with their 7-day average (null until seven days are in view)."""
    last = last_day(sales)
    return moving_average(_zero_filled(sales, F.greatest(first_day(sales), F.date_sub(last, days - 1)), last), 7)


def moving_average(series: DataFrame, at_least: int) -> DataFrame:
    """7-day moving average per product over a dense series; null until `at_least` days are in view.

    A product has one row per day of the window, so the partitions are bounded by the calendar.
    """
    week = Window.partitionBy("product_id").orderBy("day").rowsBetween(-6, 0)
    return series.withColumn("moving_avg", F.when(F.count("units").over(week) >= at_least, F.avg("units").over(week)))


def demand_stats(sales: DataFrame) -> DataFrame:
    """Mean and population standard deviation of daily units per pair over the whole calendar, zero days included."""
    days = day_count(sales)
    daily = sales.groupBy(*PAIR, "order_date").agg(F.sum("quantity").alias("units"))
    sums = daily.groupBy(*PAIR).agg(F.sum("units").alias("total"), F.sum(F.col("units") * F.col("units")).alias("squares"))
    mean = F.col("total") / days.cast("double")
    spread = F.col("squares") / days.cast("double") - mean * mean
    return sums.select(*PAIR, mean.alias("mean_daily"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std_daily"))
