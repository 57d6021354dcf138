"""Cleaning rules: raw all-text tables to typed, deduplicated canonical tables, with counters of what changed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import parse_date, strict_number, title_case, to_number
from shelfwise.functions.firsts import POSITION, first_by, keep_first, with_position
from shelfwise.schemas import INVENTORY, MONEY, PAIR, PRICE, PRODUCTS, RESTOCKS, SALES, WAREHOUSES, Tables, conform

REPORT_COLUMNS = ["rows_in", "unparseable_dates_dropped", "duplicates_removed", "prices_filled_from_master",
                  "invalid_rows_dropped", "rows_out"]


def known_keys(df: DataFrame, products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Rows whose product and warehouse both exist."""
    return (df.join(products.select("product_id"), "product_id", "left_semi")
            .join(warehouses.select("warehouse_id"), "warehouse_id", "left_semi"))


def clean_warehouses(raw: DataFrame) -> DataFrame:
    """Trimmed texts, first row per warehouse."""
    texts = ["warehouse_id", "warehouse_name", "region"]
    trimmed = with_position(raw).withColumns({c: F.trim(c) for c in texts})
    return conform(keep_first(trimmed, ["warehouse_id"]), WAREHOUSES)


def clean_products(raw: DataFrame) -> DataFrame:
    """Trimmed names, title-case categories, numeric prices; a lead time that is no number fails the run."""
    days = strict_number(F.col("lead_time_days"))
    broken = F.raise_error(F.concat(F.lit("lead time is not a number for product "), F.coalesce("product_id", F.lit("?"))))
    typed = with_position(raw).withColumns({
        "product_name": F.trim("product_name"), "category": title_case(F.trim("category")),
        "unit_cost": to_number(F.col("unit_cost")), "unit_price": to_number(F.col("unit_price")),
        "lead_time_days": F.coalesce(days, broken.cast("double")).cast("int")})
    return conform(keep_first(typed, ["product_id"]), PRODUCTS)


def clean_inventory(raw: DataFrame, products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Complete rows with numeric counts, first row per pair, known products and warehouses only.

    A count that its type cannot hold is no number: it drops its row instead of shutting the gate for the whole refresh.
    """
    typed = with_position(raw).withColumns({c: strict_number(F.col(c)).try_cast("int") for c in ("current_stock", "reorder_level")})
    first = keep_first(typed.dropna(subset=[c for c in typed.columns if c != POSITION]), PAIR).drop(POSITION)
    return conform(known_keys(first, products, warehouses), INVENTORY)


def type_sales(raw: DataFrame) -> DataFrame:
    """Parsed dates, prices and quantities; values that cannot be parsed, and prices beyond the price type, are null."""
    return with_position(raw).withColumns({
        "order_date": parse_date(F.col("order_date")), "unit_price": to_number(F.col("unit_price")).try_cast(PRICE),
        "quantity": strict_number(F.col("quantity"))})


def dedupe_orders(typed: DataFrame) -> DataFrame:
    """One row per order id among the dated rows: the most complete one, the earliest of equals. Positions are of no use after it."""
    fields = [c for c in typed.columns if c != POSITION]
    gaps = sum((F.col(c).isNull().cast("int") for c in fields), F.lit(0))
    dated = typed.filter(F.col("order_date").isNotNull()).withColumn("_gaps", gaps)
    return first_by(dated, ["order_id"], [F.col("_gaps").asc(), F.col(POSITION).asc()]).drop("_gaps", POSITION)


def judge_sales(unique: DataFrame, products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Fill missing prices from the product master and mark invalid rows; nothing is dropped yet.

    A quantity, or a revenue, that its column cannot hold makes a row invalid.
    """
    master = products.select("product_id", F.col("unit_price").alias("_master_price"), F.lit(True).alias("_product"))
    places = warehouses.select("warehouse_id", F.lit(True).alias("_place"))
    joined = unique.join(master, "product_id", "left").join(places, "warehouse_id", "left")
    price = F.coalesce("unit_price", "_master_price")
    units = F.col("quantity").try_cast("int")
    valid = (units > 0) & _revenue(units, price).isNotNull() & price.isNotNull() & F.col("_product").isNotNull() & F.col("_place").isNotNull()
    return joined.withColumns({"no_price": F.col("unit_price").isNull(), "unit_price": price,
                               "valid": F.coalesce(valid, F.lit(False))}).drop("_master_price", "_product", "_place")


def _revenue(units: Column, price: Column) -> Column:
    return F.round(units * price, 2).try_cast(MONEY)


def accepted_sales(judged: DataFrame) -> DataFrame:
    """Valid rows with whole quantities (fractions cut off) and revenue."""
    units = F.col("quantity").try_cast("int")
    rows = judged.filter("valid").withColumns({"quantity": units, "revenue": _revenue(units, F.col("unit_price"))})
    return conform(rows, SALES)


def sales_report(typed: DataFrame, judged: DataFrame) -> DataFrame:
    """One row of counters: what came in, what was dropped and why, what went out."""
    after = judged.agg(F.struct(F.count("*").alias("unique"), F.count_if("no_price").alias("filled"),
                                F.count_if(~F.col("valid")).alias("invalid"))).scalar()
    before = typed.agg(F.count("*").alias("rows_in"), F.count_if(F.col("order_date").isNull()).alias("unparseable_dates_dropped"))
    return before.withColumn("_after", after).select(
        "rows_in", "unparseable_dates_dropped",
        (F.col("rows_in") - F.col("unparseable_dates_dropped") - F.col("_after.unique")).alias("duplicates_removed"),
        F.col("_after.filled").alias("prices_filled_from_master"), F.col("_after.invalid").alias("invalid_rows_dropped"),
        (F.col("_after.unique") - F.col("_after.invalid")).alias("rows_out"))


def clean_sales(raw: DataFrame, products: DataFrame, warehouses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean sales and their one-row report, both lazy."""
    typed = type_sales(raw)
    judged = judge_sales(dedupe_orders(typed), products, warehouses)
    return accepted_sales(judged), sales_report(typed, judged)


def clean_restocks(raw: DataFrame, products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Complete, distinct receipts with a positive quantity, known products and warehouses only."""
    typed = raw.drop(POSITION).withColumns({
        "restock_date": parse_date(F.col("restock_date")), "quantity": strict_number(F.col("quantity"))})
    typed = typed.withColumn("quantity", F.when(F.col("quantity").try_cast("int").isNotNull(), F.col("quantity")))
    rows = known_keys(typed.dropna().dropDuplicates().filter("quantity > 0"), products, warehouses)
    return conform(rows, RESTOCKS)


def clean_all(raw: Tables) -> tuple[Tables, DataFrame]:
    """Dimensions first, then the facts against them."""
    warehouses, products = clean_warehouses(raw.warehouses), clean_products(raw.products)
    sales, report = clean_sales(raw.sales, products, warehouses)
    tables = Tables(warehouses, products, clean_inventory(raw.inventory, products, warehouses),
                    clean_restocks(raw.restocks, products, warehouses), sales)
    return tables, report
