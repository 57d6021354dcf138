"""The five canonical tables, and raw exports in need of cleaning, derived from the star-schema test tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.columns import half_up
from shelfwise.schemas import (INVENTORY, MONEY, PRICE, PRODUCTS, RESTOCKS, SALES, WAREHOUSES, Tables, conform)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the supplier's nation as warehouse."""
    lines, suppliers = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "supplier")
    return lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)


def warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return conform(joined.select(_text("n_nationkey").alias("warehouse_id"), F.col("n_name").alias("warehouse_name"),
                                 F.col("r_name").alias("region")), WAREHOUSES)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(_table(spark, sf_dir, "part").select(
        _text("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
        half_up(F.col("p_retailprice") * 0.75, 4).alias("unit_cost"), F.col("p_retailprice").alias("unit_price"),
        (F.col("p_size") % 12 + 3).alias("lead_time_days")), PRODUCTS)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_lines(spark, sf_dir).filter(F.col("l_returnflag") != "R")
    return conform(lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_id"), F.col("l_shipdate").alias("order_date"),
        _text("s_nationkey").alias("warehouse_id"), _text("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("quantity"),
        half_up(F.try_divide("l_extendedprice", "l_quantity"), 4).alias("unit_price"),
        F.col("l_extendedprice").alias("revenue")), SALES)


def restocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_lines(spark, sf_dir).filter(F.col("l_returnflag") == "R")
    return conform(lines.select(
        F.col("l_shipdate").alias("restock_date"), _text("s_nationkey").alias("warehouse_id"),
        _text("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity")), RESTOCKS)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = order_lines(spark, sf_dir).select("s_nationkey", "l_partkey").distinct()
    w, p = F.col("s_nationkey"), F.col("l_partkey")
    return conform(pairs.select(
        _text("s_nationkey").alias("warehouse_id"), _text("l_partkey").alias("product_id"),
        ((p * 31 + w * 17) % 97).alias("current_stock"), ((p * 13 + w * 7) % 41).alias("reorder_level")), INVENTORY)


def canonical(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(warehouses(spark, sf_dir), products(spark, sf_dir), inventory(spark, sf_dir),
                  restocks(spark, sf_dir), sales(spark, sf_dir))


# ------------------------------------------------------------------------------------------------- raw exports
# The raw exports are dated ten years later: the quality gate refuses order dates before 2000.
LATER_DAYS = 3653


def _ship_day() -> Column:
    return F.date_add(F.col("l_shipdate").cast("date"), LATER_DAYS)


def _messy_date(day: Column, key: Column) -> Column:
    """Three spellings of the same day, and now and then no date at all."""
    return (F.when(key % 89 == 7, F.lit("unknown"))
            .when(key % 3 == 0, F.date_format(day, "yyyy-MM-dd"))
            .when(key % 3 == 1, F.date_format(day, "dd/MM/yyyy"))
            .otherwise(F.date_format(day, "dd-MMM-yyyy")))


def _messy_price(price: Column, key: Column) -> Column:
    amount = price.cast(MONEY).cast("string")
    return (F.when(key % 41 == 3, F.lit(None).cast("string"))
            .when(key % 4 == 0, F.concat(F.lit("$"), amount))
            .when(key % 4 == 1, F.concat(F.lit("Rs. "), amount))
            .when(key % 4 == 2, F.concat(amount, F.lit(" USD")))
            .otherwise(amount))


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text sales export: repeated order ids, three date spellings, currency text, gaps, unknown products."""
    lines = order_lines(spark, sf_dir).filter(F.col("l_returnflag") != "R")
    key, qty = F.col("l_orderkey") + F.col("l_linenumber") + F.col("l_partkey"), F.col("l_quantity").cast("int")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_id"),
        _messy_date(_ship_day(), key).alias("order_date"),
        F.when(key % 61 != 5, _text("s_nationkey")).alias("warehouse_id"),
        F.when(key % 53 == 2, F.concat(F.lit("X"), _text("l_partkey"))).otherwise(_text("l_partkey")).alias("product_id"),
        F.when(key % 47 == 1, F.lit("0")).when(key % 47 == 2, F.lit(None).cast("string")).otherwise(qty.cast("string")).alias("quantity"),
        _messy_price(half_up(F.try_divide("l_extendedprice", "l_quantity"), 2), key).alias("unit_price"))


def raw_restocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_lines(spark, sf_dir).filter(F.col("l_returnflag") == "R")
    key, qty = F.col("l_orderkey") + F.col("l_linenumber") + F.col("l_partkey"), F.col("l_quantity").cast("int")
    return lines.select(
        _messy_date(_ship_day(), key).alias("restock_date"), _text("s_nationkey").alias("warehouse_id"),
        F.when(key % 53 == 2, F.concat(F.lit("X"), _text("l_partkey"))).otherwise(_text("l_partkey")).alias("product_id"),
        F.when(key % 47 == 1, F.lit("-4")).when(key % 47 == 2, F.lit("n/a")).otherwise(qty.cast("string")).alias("quantity"))


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product twice: as bought, and a later spelling that keep-first must drop."""
    part = _table(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast(MONEY).cast("string")
    cost = half_up(F.col("p_retailprice") * 0.75, 2).cast(MONEY).cast("string")
    days = (F.col("p_size") % 12 + 3).cast("string")
    copies = F.explode(F.array(F.lit("1"), F.lit("2"))).alias("copy")
    return part.select("*", copies).select(
        _text("p_partkey").alias("product_id"),
        F.concat(F.lit("  "), "p_name", F.when(F.col("copy") == "2", F.lit(" old")).otherwise(F.lit(" "))).alias("product_name"),
        F.concat(F.lit(" "), F.lower("p_type"), F.lit("-"), "p_type", F.lit(" ")).alias("category"),
        F.concat(F.lit("$"), cost).alias("unit_cost"), F.concat(F.lit("Rs. "), price).alias("unit_price"),
        days.alias("lead_time_days"))


def raw_warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded names, every warehouse twice."""
    copies = F.explode(F.array(F.lit(""), F.lit(" (old)"))).alias("copy")
    return warehouses(spark, sf_dir).select("*", copies).select(
        F.concat(F.lit(" "), "warehouse_id", F.lit(" ")).alias("warehouse_id"),
        F.concat(F.lit(" "), "warehouse_name", "copy").alias("warehouse_name"),
        F.concat("region", F.lit("  ")).alias("region"))


def raw_inventory(spark: SparkSession, sf_dir: str, overflowing: bool = False) -> DataFrame:
    """Stock counts as text with gaps, unknown products and a second row per pair; on request a few counts that are too large."""
    stock = inventory(spark, sf_dir)
    key = F.col("product_id").cast("bigint") + F.col("warehouse_id").cast("bigint")
    copies = F.explode(F.array(F.lit(0), F.lit(100))).alias("copy")
    return stock.select("*", copies).select(
        "warehouse_id",
        F.when(key % 53 == 2, F.concat(F.lit("X"), "product_id")).otherwise(F.col("product_id")).alias("product_id"),
        F.when((key % 83 == 9) & (F.col("copy") == 0) & F.lit(overflowing), F.lit(TOO_LARGE))
        .when(key % 47 == 1, F.lit("none")).otherwise((F.col("current_stock") + F.col("copy")).cast("string")).alias("current_stock"),
        F.when(key % 43 == 1, F.lit(None).cast("string")).otherwise(F.col("reorder_level").cast("string")).alias("reorder_level"))


def raw_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(raw_warehouses(spark, sf_dir), raw_products(spark, sf_dir), raw_inventory(spark, sf_dir),
                  raw_restocks(spark, sf_dir), raw_sales(spark, sf_dir))


# ------------------------------------------------------------------------------------------- exports of a business
# Rows of an export or a stock count with a number that no canonical type holds.
TOO_LARGE = "99999999999"


def sales_export(spark: SparkSession, sf_dir: str, overflowing: bool = False) -> DataFrame:
    """A shop's own sales export: day-first dates, currency text, returns, blank codes, missing invoice numbers; on request a few
    quantities that are too large."""
    lines = order_lines(spark, sf_dir)
    key, qty = F.col("l_orderkey") + F.col("l_linenumber") + F.col("l_partkey"), F.col("l_quantity").cast("int")
    return lines.select(
        F.when(key % 89 == 7, F.lit("not a date")).otherwise(F.date_format(_ship_day(), "dd/MM/yyyy")).alias("Bill Date"),
        F.when(key % 59 == 3, F.lit("  ")).when(key % 59 == 4, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), _text("l_partkey"), F.lit(" "))).alias("Item Code"),
        F.when((key % 83 == 9) & F.lit(overflowing), F.lit(TOO_LARGE))
        .when(key % 47 == 2, F.lit(None).cast("string")).when(key % 47 == 1, F.lit("0"))
        .when(F.col("l_returnflag") == "R", (-qty).cast("string")).otherwise(qty.cast("string")).alias("Qty Sold"),
        F.when(key % 61 != 5, _text("s_nationkey")).alias("Branch"),
        F.when(key % 5 != 0, _messy_price(half_up(F.try_divide("l_extendedprice", "l_quantity"), 2), key)).alias("Rate"),
        F.when(key % 7 != 0, F.col("l_extendedprice").cast(MONEY).cast("string")).alias("Line Total"),
        F.when(key % 3 != 0, F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("Invoice"))


def stock_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock counts with negative rows, a place that never sells, codes that never sold and reorder levels of 0."""
    stock = inventory(spark, sf_dir)
    p, w = F.col("product_id").cast("bigint"), F.col("warehouse_id").cast("bigint")
    copies = F.explode(F.array(F.lit(0), F.lit(5))).alias("copy")
    return stock.select("*", copies).select(
        F.when((p + w) % 53 == 2, F.concat(F.lit("Z"), "product_id")).otherwise(F.col("product_id")).alias("SKU"),
        F.when((p + w) % 71 == 2, F.lit("DEPOT")).otherwise(F.col("warehouse_id")).alias("Branch"),
        F.when((p + w) % 67 == 3, F.lit("-1")).when((p + w) % 67 == 4, F.lit("?"))
        .otherwise((F.col("current_stock") + F.col("copy")).cast("string")).alias("On Hand"),
        F.when((p * w) % 3 == 1, F.col("reorder_level").cast("string")).alias("Min Stock"))


def product_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product master that misses some products, prices, costs, names, categories and lead times."""
    key = F.col("p_partkey")
    return _table(spark, sf_dir, "part").filter(F.col("p_brand") != "Brand#7").select(
        _text("p_partkey").alias("sku"), F.when(key % 11 != 3, F.col("p_name")).alias("product_name"),
        F.when(key % 13 != 4, F.lower("p_type")).alias("category"),
        F.when(key % 6 != 1, F.col("p_retailprice").cast(PRICE).cast("string")).alias("unit_cost"),
        F.when(key % 4 == 1, F.concat(F.lit("$"), F.col("p_retailprice").cast(MONEY).cast("string"))).alias("unit_price"),
        F.when(key % 9 != 2, (F.col("p_size") % 12).cast("string")).alias("lead_time_days"))


def store_item_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per date, store and item."""
    lines = order_lines(spark, sf_dir)
    return (lines.groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("s_nationkey").alias("store"),
                          F.col("l_partkey").alias("item"))
            .agg(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0)).cast("bigint").alias("sales")))
