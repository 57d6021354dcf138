"""The import of a business's own exports: canonical tables, and findings as rows.

A finding says what was read, dropped, assumed or is wrong: (kind, code, rows, text). Findings about data are aggregates over the
staged steps of the import; the driver only decides which steps apply.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage
from shelfwise.operators import importing as im
from shelfwise.operators.importing import Export, Fallbacks
from shelfwise.operators.quality import quality_report
from shelfwise.schemas import INVENTORY, PRODUCTS, RESTOCKS, Tables, conform

SHORT_HISTORY_DAYS = 60
ROWS, DROPPED, ASSUMED, WARNING, ERROR = "rows", "dropped", "assumed", "warning", "error"

#: Kind and text by code. The number of rows stands beside the text.
TEXTS: dict[str, tuple[str, str]] = {
    "rows_in": (ROWS, "sales rows read"),
    "rows_out": (ROWS, "sales rows imported"),
    "days": (ROWS, "days from the first to the last order"),
    "first_day": (ROWS, "first order day"),
    "last_day": (ROWS, "last order day"),
    "date_reading": (ASSUMED, "reading of the date column"),
    "one_place": (ASSUMED, "sales rows without a location column, put at the fallback place"),
    "derived_prices": (ASSUMED, "prices computed as amount over quantity"),
    "assumed_costs": (ASSUMED, "products costed at the fallback share of their price"),
    "assumed_lead_times": (ASSUMED, "products with the fallback lead time"),
    "recommended_levels": (ASSUMED, "stock positions without a reorder level, or with 0, which get the recommended reorder point"),
    "shared_order_ids": (WARNING, "rows left out because an earlier one has their order id; unmap the id if it names a whole invoice"),
    "unlisted_products": (WARNING, "sold products that the product export does not list"),
    "unpriced_products": (WARNING, "products without any price, valued at 1 per unit"),
    "unsold_products": (WARNING, "stocked products without a sale, priced like the median product"),
    "short_history": (WARNING, "days of sales only: forecasts and variability are weak"),
    "product_export_unread": (WARNING, "product export without a product column, not read"),
    "stock_export_unread": (WARNING, "stock export without a product or stock column, not read"),
    "stock_without_place": (WARNING, "stock export without a location column while sales have several places, not read"),
    "no_stock": (WARNING, "no stock: orders, alerts and stock figures need it"),
    "missing_column": (ERROR, "required fields without a column"),
    "nothing_left": (ERROR, "no sales row is usable: look at the mapping and the date format"),
}
SCHEMA = "kind string, code string, rows bigint, text string"


@dataclass(frozen=True)
class Imported:
    """Canonical tables (none after an error) and the findings."""

    tables: Tables | None
    findings: DataFrame

    @property
    def ok(self) -> bool:
        return self.tables is not None


def _counted(df: DataFrame, **codes: Column) -> DataFrame:
    """Findings from aggregates over one frame; a warning or assumption about no row is left out."""
    sums = df.agg(*[c.cast("bigint").alias(code) for code, c in codes.items()])
    entries = [F.struct(F.lit(TEXTS[code][0]).alias("kind"), F.lit(code).alias("code"), F.coalesce(F.col(code), F.lit(0)).alias("rows"),
                        F.lit(TEXTS[code][1]).alias("text")) for code in codes]
    return sums.select(F.explode(F.array(*entries)).alias("f")).select("f.*").filter(f"rows > 0 OR kind = '{ROWS}'")


def _dropped(df: DataFrame, reason: Column) -> DataFrame:
    """Findings from rows that are left out, per reason."""
    counts = df.select(reason.alias("code")).filter("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("rows"))
    return counts.select(F.lit(DROPPED).alias("kind"), "code", "rows", F.col("code").alias("text"))


def _dated(df: DataFrame, **codes: Column) -> DataFrame:
    """Findings that name a day."""
    entries = [F.struct(F.lit(TEXTS[code][0]).alias("kind"), F.lit(code).alias("code"), F.lit(0).cast("bigint").alias("rows"),
                        F.concat(F.lit(TEXTS[code][1] + ": "), F.date_format(code, "yyyy-MM-dd")).alias("text")) for code in codes]
    return df.agg(*[c.alias(code) for code, c in codes.items()]).select(F.explode(F.array(*entries)).alias("f")).select("f.*")


def _noted(spark: SparkSession, code: str, rows: int = 0, about: str = "") -> DataFrame:
    """A finding about the columns, not the data."""
    kind, text = TEXTS[code]
    return spark.createDataFrame([(kind, code, rows, f"{text}: {about}" if about else text)], SCHEMA)


def _stock_step(stock: Export, draft: Tables, fallbacks: Fallbacks) -> tuple[Tables, list[DataFrame]]:
    """The tables with the stock export, and what is to be said about it."""
    spark = draft.sales.sparkSession
    places = [r["warehouse_id"] for r in draft.warehouses.select("warehouse_id").limit(2).collect()]
    if stock.lacking:
        return draft, [_noted(spark, "stock_export_unread", about=", ".join(stock.lacking)), _noted(spark, "no_stock")]
    if not stock.has("warehouse_id") and len(places) > 1:
        return draft, [_noted(spark, "stock_without_place"), _noted(spark, "no_stock")]
    labels = stage(im.label_stock(stock, places[0]), "stock-labels")
    positions = stage(im.stock_positions(labels), "stock")
    unsold = stage(im.unsold_products(positions, draft.products, fallbacks), "unsold-products")
    held = draft.with_(warehouses=im.places(draft.sales, positions), products=draft.products.unionByName(unsold),
                       inventory=conform(positions, INVENTORY))
    levels = stage(im.recommended_levels(held, fallbacks.policy), "inventory")
    said = [_dropped(labels, F.when(~F.col("usable"), im.BAD_STOCK)), _counted(unsold, unsold_products=F.count("*")),
            _counted(positions, recommended_levels=F.count_if("no_level"))]
    return held.with_(inventory=levels), said


def import_data(sales: Export, stock: Export | None = None, products: Export | None = None, fallbacks: Fallbacks = Fallbacks()) -> Imported:
    """Canonical tables from a sales export and, where there are any, stock and product exports."""
    spark = sales.rows.sparkSession
    if sales.lacking:
        return Imported(None, _noted(spark, "missing_column", len(sales.lacking), ", ".join(sales.lacking)))
    rule = im.choose_date_rule(sales.rows, sales.text("order_date"), fallbacks.day_first)
    labelled = stage(im.label_sales(sales, rule, fallbacks), "labelled")
    orders = stage(im.unique_orders(im.number_orders(labelled)), "unique-orders")
    kept, unique = F.count_if(F.col("reason").isNull()), orders.agg(F.count("*")).scalar()
    said = [_noted(spark, "date_reading", about=rule.note), _dropped(labelled, F.col("reason")),
            _counted(labelled, rows_in=F.count("*"), derived_prices=F.count_if("derived"), shared_order_ids=kept - F.max(unique)),
            _counted(orders, rows_out=F.count("*"), **({} if sales.has("warehouse_id") else {"one_place": F.count("*")}))]
    if orders.isEmpty():
        return Imported(None, reduce(DataFrame.unionByName, [*said, _noted(spark, "nothing_left")]))

    master = im.product_master(products)
    if products is not None and master is None:
        said.append(_noted(spark, "product_export_unread"))
    sold = stage(im.sold_products(orders, master, fallbacks), "sold-products")
    unlisted = {"unlisted_products": F.count_if(~F.col("in_master"))} if master is not None else {}
    said.append(_counted(sold, unpriced_products=F.count_if("no_price"), assumed_costs=F.count_if("no_cost"),
                         assumed_lead_times=F.count_if("no_lead_time"), **unlisted))

    dimension = conform(sold, PRODUCTS)
    priced = stage(im.priced_sales(orders, dimension), "sales")
    tables = Tables(im.places(priced), dimension, spark.createDataFrame([], INVENTORY), spark.createDataFrame([], RESTOCKS), priced)
    days = F.datediff(F.max("order_date"), F.min("order_date")) + 1
    said.append(_counted(priced, days=days, short_history=F.when(days < SHORT_HISTORY_DAYS, days)))
    said.append(_dated(priced, first_day=F.min("order_date"), last_day=F.max("order_date")))
    if stock is None:
        said.append(_noted(spark, "no_stock"))
    else:
        tables, more = _stock_step(stock, tables, fallbacks)
        said += more
    gate = stage(quality_report(tables, strict=False).filter("violations > 0"), "import-gate")
    said.append(gate.select(F.lit(ERROR).alias("kind"), F.col("check").alias("code"), F.col("violations").alias("rows"), F.col("check").alias("text")))
    return Imported(tables if gate.isEmpty() else None, reduce(DataFrame.unionByName, said))
