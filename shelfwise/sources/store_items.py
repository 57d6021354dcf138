"""Adapter for store-item demand data (date, store, item, sales) to the canonical tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.ordering import number_in_groups
from shelfwise.operators.importing import Fallbacks
from shelfwise.schemas import INVENTORY, PRODUCTS, RESTOCKS, SALES, WAREHOUSES, Tables, conform

# Product categories, chosen by item number.
CATEGORIES = ("Beverages", "Snacks", "Household", "Personal Care", "Staples")


def adapt_store_items(demand: DataFrame, n_items: int | None = None, fallbacks: Fallbacks = Fallbacks()) -> Tables:
    """Stores become warehouses, items products, and every date with units an order line.

    The data has no prices, costs or lead times: the import fallbacks stand in (price 1). It has no stock and no receipts.
    """
    spark = demand.sparkSession
    d = demand.toDF(*[c.lower() for c in demand.columns])
    d = d.select(F.col("date").cast("date").alias("date"), F.col("store").cast("int").alias("store"),
                 F.col("item").cast("int").alias("item"), F.col("sales").cast("int").alias("units"))
    if n_items:
        d = d.filter(F.col("item") <= n_items)
    place, product = F.format_string("S%02d", F.col("store")), F.format_string("I%03d", F.col("item"))

    warehouses = d.select("store").distinct().select(
        place.alias("warehouse_id"), F.format_string("Store %d", F.col("store")).alias("warehouse_name"), F.lit("n/a").alias("region"))
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    products = d.select("item").distinct().select(
        product.alias("product_id"), F.format_string("Item %03d", F.col("item")).alias("product_name"),
        names[F.col("item") % len(CATEGORIES)].alias("category"), F.lit(fallbacks.cost_share).alias("unit_cost"),
        F.lit(1.0).alias("unit_price"), F.lit(fallbacks.lead_days).alias("lead_time_days"))
    lines = number_in_groups(d.filter(F.col("units") > 0), [F.col("date")], [F.col("store").asc(), F.col("item").asc()], "line")
    sales = lines.select(
        F.format_string("K%07d", F.col("line")).alias("order_id"), F.col("date").alias("order_date"), place.alias("warehouse_id"),
        product.alias("product_id"), F.col("units").alias("quantity"), F.lit(1.0).alias("unit_price"), F.col("units").alias("revenue"))
    return Tables(conform(warehouses, WAREHOUSES), conform(products, PRODUCTS), spark.createDataFrame([], INVENTORY),
                  spark.createDataFrame([], RESTOCKS), conform(sales, SALES))
