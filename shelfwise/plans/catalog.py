"""Every registered query with its SQL restatement, over the star-schema test tables."""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.columns import half_up, parse_date, to_number
from shelfwise.functions import months
from shelfwise.functions.firsts import keep_last
from shelfwise.functions.staging import new_path, stage
from shelfwise.operators import cleaning, demand, forecast, health, kpis, quality, replenish, rollups, segments, served, transfers
from shelfwise.operators import importing as im
from shelfwise.operators import measures as ms
from shelfwise.operators import summaries as su
from shelfwise.plans import imports, oracle as o, refresh, testbed
from shelfwise.plans.oracle import B, D, R, pct, q
from shelfwise.schemas import PAIR, TABLE_SCHEMAS, Policy, Tables
from shelfwise.sources import files, store_items

QUERIES: dict[str, Callable[["Bed"], DataFrame]] = {}
SQL: dict[str, str] = {}


def load_all_sums(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {grain: files.load_sums(spark, folder, grain) for grain in rollups.GRAINS}


class Bed:
    """Lazy handles on the test tables of one folder, or on a loaded table set."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: Tables | None = None, sums: dict[str, DataFrame] | None = None):
        self.spark, self.sf_dir, self.loaded, self.sums = spark, sf_dir, tables, sums

    @cached_property
    def t(self) -> Tables:
        return self.loaded or testbed.canonical(self.spark, self.sf_dir)

    @cached_property
    def raw(self) -> Tables:
        return testbed.raw_tables(self.spark, self.sf_dir)

    def added(self, grain: str) -> DataFrame:
        """What queries that only add up read: the sums a refresh keeps where they are loaded, else the order lines."""
        return self.sums[grain] if self.sums else self.t.sales

    def refreshed(self) -> "Bed":
        """The same tables out of clean files, with their sums by month."""
        folder = self.written()
        return Bed(self.spark, self.sf_dir, files.load_clean(self.spark, folder), load_all_sums(self.spark, folder))

    @property
    def sw(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.t.sales, self.t.products, self.t.warehouses

    @property
    def positions(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return self.t.sales, self.t.inventory, self.t.products, self.t.warehouses

    @property
    def receipts(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return self.t.sales, self.t.inventory, self.t.restocks, self.t.products

    @cached_property
    def repl(self) -> DataFrame:
        return replenish.replenishment(*self.positions)

    @cached_property
    def alerts(self) -> DataFrame:
        return kpis.reorder_alerts(*self.positions)

    @cached_property
    def transfers(self) -> DataFrame:
        return transfers.transfer_suggestions(self.repl, self.t.products)

    @cached_property
    def abc(self) -> DataFrame:
        return segments.abc_xyz(self.t.sales, self.t.products)

    # ---- import of the exports
    @cached_property
    def sales_export(self) -> DataFrame:
        return testbed.sales_export(self.spark, self.sf_dir)

    @cached_property
    def labelled(self) -> DataFrame:
        return im.label_sales(im.Export.of(self.sales_export, "sales"), im.choose_date_rule(self.sales_export, F.col("`Bill Date`")))

    @cached_property
    def numbered(self) -> DataFrame:
        return im.number_orders(stage(self.labelled, "labelled"))

    @cached_property
    def orders(self) -> DataFrame:
        return im.unique_orders(self.numbered)

    @cached_property
    def master(self) -> DataFrame:
        return im.product_master(im.Export.of(testbed.product_export(self.spark, self.sf_dir), "products"))

    @cached_property
    def sold(self) -> DataFrame:
        return im.sold_products(self.orders, self.master)

    @cached_property
    def stock_labels(self) -> DataFrame:
        return im.label_stock(im.Export.of(testbed.stock_export(self.spark, self.sf_dir), "stock"))

    @cached_property
    def imported(self) -> imports.Imported:
        done = imports.import_data(
            im.Export.of(self.sales_export, "sales"), im.Export.of(testbed.stock_export(self.spark, self.sf_dir), "stock"),
            im.Export.of(testbed.product_export(self.spark, self.sf_dir), "products"))
        if not done.ok:
            raise ValueError(f"import failed: {done.findings.filter(F.col('kind') == imports.ERROR).collect()}")
        return done

    def written(self, csv_only: bool = False) -> str:
        """Folder with the canonical tables as clean files."""
        folder = new_path(self.spark, "clean")
        if csv_only:
            for name, df in self.t.items():
                files.write_csv(df, f"{folder}/{name}.csv")
        else:
            files.write_clean(self.t, folder, csv=False)
        return folder

    def raw_folder(self) -> str:
        """Folder with the raw exports as CSV; the rows lie in the order of all their columns, which is then the file order."""
        folder = new_path(self.spark, "raw")
        for name, df in self.raw.items():
            files.write_csv(df.orderBy(*df.columns), f"{folder}/raw_{name}.csv")
        return folder


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and whole numbers as bigint, so that results of different engines compare."""
    kinds = {T.DecimalType: "double", T.IntegerType: "bigint", T.ShortType: "bigint"}
    return df.select([F.col(f"`{f.name}`").cast(kinds[type(f.dataType)]).alias(f.name) if type(f.dataType) in kinds else F.col(f"`{f.name}`")
                      for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Bed], DataFrame]) -> Callable[[Bed], DataFrame]:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return register


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: half_up(F.col(n), digits) for n in names})


# ================================================================================================ sources and sinks
RAW_COUNTS = "SELECT " + ", ".join(
    ["COUNT(*) AS row_count"] + [f"COUNT({c}) AS {c}_count" for c in ("order_id", "order_date", "warehouse_id", "product_id", "quantity", "unit_price")]
    + ["COUNT(DISTINCT order_id) AS order_ids", "MIN(order_date) AS first_text", "MAX(unit_price) AS last_price"]) + " FROM raw_sales"


@query("s1_raw_csv_scan", q(RAW_COUNTS, o.RAW))
def _(b: Bed) -> DataFrame:
    s = files.read_raw(b.spark, b.raw_folder()).sales
    names = ("order_id", "order_date", "warehouse_id", "product_id", "quantity", "unit_price")
    return s.agg(F.count("*").alias("row_count"), *[F.count(c).alias(f"{c}_count") for c in names],
                 F.count_distinct("order_id").alias("order_ids"), F.min("order_date").alias("first_text"), F.max("unit_price").alias("last_price"))


def _joined(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _figures(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and column the values that are there and their sum: of numbers, of days since 1970, of text lengths."""
    how = {"string": F.length, "date": F.unix_date}

    def of(name: str, df: DataFrame) -> DataFrame:
        fields = [(f.name, how.get(f.dataType.simpleString(), F.col)(f.name)) for f in TABLE_SCHEMAS[name].fields]
        sums = df.agg(*[F.count(c).alias(f"n_{c}") for c, _ in fields], *[F.sum(v).cast("double").alias(f"s_{c}") for c, v in fields])
        entries = [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("present"), F.col(f"s_{c}").alias("figure"))
                   for c, _ in fields]
        return sums.select(F.explode(F.array(*entries)).alias("e")).select("e.*")

    return _joined([of(name, df) for name, df in tables.items()])


CANONICAL = {name: f"SELECT * FROM {name}" for name in TABLE_SCHEMAS}
CLEANED = {"warehouses": "SELECT * FROM cw", "products": f"SELECT {o.PRODUCT_OUT} FROM cp", "inventory": "SELECT * FROM ci",
           "restocks": "SELECT * FROM cr", "sales": f"SELECT {o.SALES_OUT} FROM cs"}


@query("s2_clean_parquet", q(f"""SELECT CAST(year(order_date) AS BIGINT) AS year, CAST(month(order_date) AS BIGINT) AS month, COUNT(*) AS row_count,
    {B('SUM(quantity)')} AS units, {D('SUM(revenue)')} AS revenue, {D('SUM(unit_price)')} AS prices FROM sales GROUP BY 1, 2"""))
def _(b: Bed) -> DataFrame:
    s = files.read_table(b.spark, b.written(), "sales")
    return s.groupBy(F.year("order_date").alias("year"), F.month("order_date").alias("month")).agg(
        F.count("*").alias("row_count"), F.sum("quantity").alias("units"), F.sum("revenue").alias("revenue"), F.sum("unit_price").alias("prices"))


@query("s3_csv_copy", q(f"SELECT restock_date, COUNT(*) AS row_count, {B('SUM(quantity)')} AS units FROM restocks GROUP BY 1"))
def _(b: Bed) -> DataFrame:
    r = files.read_table(b.spark, b.written(csv_only=True), "restocks")
    return r.groupBy("restock_date").agg(F.count("*").alias("row_count"), F.sum("quantity").alias("units"))


@query("s4_load_clean", q(o.figures(CANONICAL, TABLE_SCHEMAS)))
def _(b: Bed) -> DataFrame:
    return _figures(dict(files.load_clean(b.spark, b.written()).items()))


@query("s5_source_fallback", q(f"SELECT COUNT(*) AS row_count, {B('SUM(current_stock)')} AS stock, 'second' AS source FROM inventory"))
def _(b: Bed) -> DataFrame:
    folder = b.written()
    tables, label = files.load_data(b.spark, [f"{folder}/nothing-here", folder])
    source = "second" if label == folder else "other"
    return tables.inventory.agg(F.count("*").alias("row_count"), F.sum("current_stock").alias("stock"), F.lit(source).alias("source"))


@query("s6_import_reader", q("""SELECT COUNT(*) AS row_count, COUNT(bill_date) AS dates, COUNT(NULLIF(trim(item), '')) AS items, COUNT(qty_sold) AS quantities,
    COUNT(branch) AS branches, COUNT(rate) AS rates, COUNT(line_total) AS totals, COUNT(invoice) AS invoices FROM exp""", o.EXPORT))
def _(b: Bed) -> DataFrame:
    path = new_path(b.spark, "export")
    files.write_csv(b.sales_export, path)
    e = files.read_text_csv(b.spark, path)
    counts = {"Bill Date": "dates", "Qty Sold": "quantities", "Branch": "branches", "Rate": "rates", "Line Total": "totals", "Invoice": "invoices"}
    items = F.count(F.nullif(F.trim(F.col("`Item Code`")), F.lit(""))).alias("items")
    return e.agg(F.count("*").alias("row_count"), items, *[F.count(F.col(f"`{c}`")).alias(n) for c, n in counts.items()])


@query("s7_cleaning_report", q(o.CLEAN_REPORT + """, (SELECT COUNT(*) FROM cw) AS rows_warehouses, (SELECT COUNT(*) FROM cp) AS rows_products,
    (SELECT COUNT(*) FROM ci) AS rows_inventory, (SELECT COUNT(*) FROM cr) AS rows_restocks, (SELECT COUNT(*) FROM cs) AS rows_sales""", o.RAW, o.CLEAN))
def _(b: Bed) -> DataFrame:
    return refresh.refresh(b.spark, b.raw_folder(), new_path(b.spark, "refreshed"), csv=False)


@query("s8_star_export", q(o.figures(CANONICAL, TABLE_SCHEMAS)))
def _(b: Bed) -> DataFrame:
    folder = new_path(b.spark, "star")
    files.export_star_schema(b.t, folder)
    read = b.spark.read.options(header=True, escape='"', dateFormat=files.DATE_FORMAT)
    return _figures({name: read.schema(TABLE_SCHEMAS[name]).csv(f"{folder}/{star}.csv") for name, star in files.STAR_NAMES.items()})


#: A figure per sheet of the action pack, and its SQL.
PACK_FIGURES = {"orders_to_place": ("suggested_order_qty", "repl WHERE below_rop"), "stockout_risk": ("lead_time_days", "repl WHERE stockout_risk_pct >= 50"),
                "transfers": ("quantity", "transfers"), "excess_stock": ("excess_units", "repl WHERE excess_value > 0"), "abc_xyz": ("revenue", "abc")}
PACK_SQL = "SELECT 'summary' AS sheet, CAST(8 AS BIGINT) AS row_count, CAST(NULL AS DOUBLE) AS figure" + "".join(
    f" UNION ALL SELECT '{sheet}', COUNT(*), CAST(SUM(CAST({column} AS DECIMAL(18, 2))) AS DOUBLE) FROM {rows}" for sheet, (column, rows) in PACK_FIGURES.items())


@query("s9_action_pack", q(PACK_SQL, o.REPL, o.TRANSFERS, o.RATES, o.ABC))
def _(b: Bed) -> DataFrame:
    folder = new_path(b.spark, "pack")
    policy = stage(b.repl, "policy")                           # four sheets, the summary and the transfers start from it
    moves = transfers.transfer_suggestions(policy, b.t.products)
    files.export_result_sets(su.action_pack(policy, health.inventory_health(b.t.sales, policy), b.abc, moves), folder)
    sheets = {"summary": F.lit(None), **{sheet: F.sum(F.col(column).cast("decimal(18,2)")) for sheet, (column, _) in PACK_FIGURES.items()}}
    return _joined([b.spark.read.parquet(f"{folder}/{s}.parquet").agg(F.lit(s).alias("sheet"), F.count("*").alias("row_count"), v.cast("double").alias("figure"))
                    for s, v in sheets.items()])


@query("s10_csv_downloads", q(f"""SELECT 'purchase_suggestions' AS file, COUNT(*) AS row_count, {B('SUM(suggested_order_qty)')} AS units FROM repl WHERE below_rop
UNION ALL SELECT 'reorder_alerts', COUNT(*), {B('SUM(shortfall)')} FROM alerts""", o.REPL, o.ALERTS))
def _(b: Bed) -> DataFrame:
    folder = new_path(b.spark, "downloads")
    files.export_result_sets({"purchase_suggestions": replenish.orders_to_place(b.repl), "reorder_alerts": b.alerts}, folder, "csv")
    read = b.spark.read.option("header", True).csv
    orders, alerts = read(f"{folder}/purchase_suggestions.csv"), read(f"{folder}/reorder_alerts.csv")
    return (orders.agg(F.lit("purchase_suggestions").alias("file"), F.count("*").alias("row_count"), F.sum(F.col("suggested_order_qty").cast("bigint")).alias("units"))
            .unionByName(alerts.agg(F.lit("reorder_alerts").alias("file"), F.count("*").alias("row_count"), F.sum(F.col("shortfall").cast("bigint")).alias("units"))))


@query("s11_json_records", q("""SELECT '{"restock_date":"' || strftime(restock_date, '%Y-%m-%dT00:00:00') || '","warehouse_id":"' || warehouse_id
    || '","product_id":"' || product_id || '","quantity":' || quantity || '}' AS record FROM restocks"""))
def _(b: Bed) -> DataFrame:
    return files.json_records(b.t.restocks)


@query("s12_repeated_refresh", q("SELECT *, figure AS second_figure FROM (" + o.figures(CLEANED, TABLE_SCHEMAS) + ")", o.RAW, o.CLEAN))
def _(b: Bed) -> DataFrame:
    raw, clean, figures = b.raw_folder(), new_path(b.spark, "refreshed"), []
    for _ in range(2):
        refresh.refresh(b.spark, raw, clean, csv=False)
        figures.append(_figures(dict(files.load_clean(b.spark, clean).items())))
    second = figures[1].select("table_name", "column_name", F.col("figure").alias("second_figure"))
    return figures[0].join(second, ["table_name", "column_name"])


# ================================================================================================ cleaning
@query("c1_to_number", q(f"SELECT order_id, unit_price, {o.num('unit_price')} AS price FROM raw_sales", o.RAW))
def _(b: Bed) -> DataFrame:
    return b.raw.sales.select("order_id", "unit_price", to_number(F.col("unit_price")).alias("price"))


@query("c2_parse_dates", q(f"SELECT order_id, order_date AS text, {o.clean_date('order_date')} AS order_date FROM raw_sales", o.RAW))
def _(b: Bed) -> DataFrame:
    return b.raw.sales.select("order_id", F.col("order_date").alias("text"), parse_date(F.col("order_date")).alias("order_date"))


@query("c3_clean_warehouses", q("SELECT * FROM cw", o.RAW, o.CLEAN))
def _(b: Bed) -> DataFrame:
    return cleaning.clean_warehouses(b.raw.warehouses)


@query("c4_clean_products", q(f"SELECT {o.PRODUCT_OUT} FROM cp", o.RAW, o.CLEAN))
def _(b: Bed) -> DataFrame:
    return cleaning.clean_products(b.raw.products)


@query("c5_clean_inventory", q(f"SELECT warehouse_id, product_id, {B('current_stock')} AS current_stock, {B('reorder_level')} AS reorder_level FROM ci", o.RAW, o.CLEAN))
def _(b: Bed) -> DataFrame:
    return cleaning.clean_all(b.raw)[0].inventory


@query("c6_clean_sales", q(f"SELECT {o.SALES_OUT} FROM cs", o.RAW, o.CLEAN))
def _(b: Bed) -> DataFrame:
    return cleaning.clean_all(b.raw)[0].sales


@query("c6_dedupe_orders", q("SELECT order_id, d AS order_date, warehouse_id, product_id, qn AS quantity FROM cs2", o.RAW, o.CLEAN))
def _(b: Bed) -> DataFrame:
    return cleaning.dedupe_orders(cleaning.type_sales(b.raw.sales)).select("order_id", "order_date", "warehouse_id", "product_id", "quantity")


@query("c6_sales_report", q(o.CLEAN_REPORT, o.RAW, o.CLEAN))
def _(b: Bed) -> DataFrame:
    return cleaning.clean_all(b.raw)[1]


@query("c7_clean_restocks", q(f"SELECT restock_date, warehouse_id, product_id, {B('quantity')} AS quantity FROM cr", o.RAW, o.CLEAN))
def _(b: Bed) -> DataFrame:
    return cleaning.clean_all(b.raw)[0].restocks


@query("c5_overflowing_stock", q(f"SELECT warehouse_id, product_id, {B('current_stock')} AS current_stock, {B('reorder_level')} AS reorder_level FROM ci",
                                o.RAW_TOO_LARGE, o.CLEAN))
def _(b: Bed) -> DataFrame:
    return cleaning.clean_all(b.raw.with_(inventory=testbed.raw_inventory(b.spark, b.sf_dir, overflowing=True)))[0].inventory


@query("c8_clean_all", q(o.figures(CLEANED, TABLE_SCHEMAS), o.RAW, o.CLEAN))
def _(b: Bed) -> DataFrame:
    return _figures(dict(cleaning.clean_all(b.raw)[0].items()))


@query("d1_keep_last", q("SELECT warehouse_id, product_id, current_stock, reorder_level FROM " + o.keep_one(
    "raw_inventory", "warehouse_id, product_id", o.nulls_first(["warehouse_id", "product_id", "current_stock", "reorder_level"], "DESC")), o.RAW))
def _(b: Bed) -> DataFrame:
    return keep_last(b.raw.inventory, PAIR).select(*PAIR, "current_stock", "reorder_level")


# ================================================================================================ import
@query("i4_flexible_dates", q("SELECT bill_date AS text, order_date, COUNT(*) AS row_count FROM exp1 GROUP BY 1, 2", o.EXPORT))
def _(b: Bed) -> DataFrame:
    text = F.col("`Bill Date`")
    day = im.read_date(text, im.choose_date_rule(b.sales_export, text))
    return b.sales_export.groupBy(text.alias("text"), day.alias("order_date")).agg(F.count("*").alias("row_count"))


@query("i5_normalised_sales", q("""SELECT order_date, product_id, quantity, warehouse_id, invoice_id AS order_id, reason FROM labelled""", o.EXPORT))
def _(b: Bed) -> DataFrame:
    return b.labelled.select("order_date", "product_id", "quantity", "warehouse_id", "order_id", "reason")


@query("i6_counted_drops", q("SELECT reason, COUNT(*) AS rows FROM labelled WHERE reason IS NOT NULL GROUP BY 1", o.EXPORT))
def _(b: Bed) -> DataFrame:
    return im.drop_counts(b.labelled)


@query("i7_derived_prices", q(f"SELECT product_id, quantity, derived, {R('unit_price', 4)} AS unit_price FROM kept", o.EXPORT))
def _(b: Bed) -> DataFrame:
    kept = b.labelled.filter("reason IS NULL").select("product_id", "quantity", "derived", "unit_price")
    return _rounded(kept, 4, "unit_price")


@query("i8_order_ids", q(f"SELECT order_id, order_date, warehouse_id, product_id, quantity, {R('unit_price', 4)} AS unit_price FROM kept", o.EXPORT))
def _(b: Bed) -> DataFrame:
    n = b.numbered.select("order_id", "order_date", "warehouse_id", "product_id", "quantity", "unit_price")
    return _rounded(n, 4, "unit_price")


@query("i8_order_ids_in_files", SQL["i8_order_ids"])
def _(b: Bed) -> DataFrame:
    path = new_path(b.spark, "export")
    files.write_csv(b.sales_export.orderBy(*[F.col(f"`{c}`") for c in b.sales_export.columns]), path)
    placed = files.read_text_csv(b.spark, path)
    labelled = im.label_sales(im.Export.of(placed, "sales"), im.choose_date_rule(placed, F.col("`Bill Date`")))
    n = im.number_orders(stage(labelled, "labelled")).select("order_id", "order_date", "warehouse_id", "product_id", "quantity", "unit_price")
    return _rounded(n, 4, "unit_price")


@query("i9_unique_orders", q(f"SELECT order_id, order_date, warehouse_id, product_id, {B('quantity')} AS quantity, {R('unit_price', 4)} AS unit_price FROM uniq", o.EXPORT))
def _(b: Bed) -> DataFrame:
    u = b.orders.select("order_id", "order_date", "warehouse_id", "product_id", "quantity", "unit_price")
    return _rounded(u, 4, "unit_price")


@query("i9_overflowing_quantity", q(f"""SELECT reason, COUNT(*) AS row_count, CAST(NULL AS DOUBLE) AS units FROM labelled WHERE reason IS NOT NULL GROUP BY 1
UNION ALL SELECT 'imported', COUNT(*), {D('SUM(quantity)')} FROM uniq""", o.EXPORT_TOO_LARGE))
def _(b: Bed) -> DataFrame:
    done = imports.import_data(im.Export.of(testbed.sales_export(b.spark, b.sf_dir, overflowing=True), "sales"))
    dropped = done.findings.filter(F.col("kind") == imports.DROPPED)
    sold = done.tables.sales.agg(F.lit("imported").alias("reason"), F.count("*").alias("row_count"), F.sum("quantity").cast("double").alias("units"))
    return dropped.select(F.col("code").alias("reason"), F.col("rows").alias("row_count"), F.lit(None).cast("double").alias("units")).unionByName(sold)


@query("i10_product_dimension", q(f"SELECT {o.PRODUCT_OUT}, in_master, no_price, no_cost, no_lead_time FROM soldp", o.EXPORT, o.PEXP))
def _(b: Bed) -> DataFrame:
    return b.sold


@query("i10_median_prices", q(f"SELECT product_id, {R('median_price', 4)} AS median_price FROM medians WHERE median_price IS NOT NULL", o.EXPORT, o.PEXP))
def _(b: Bed) -> DataFrame:
    return _rounded(im.median_prices(b.orders), 4, "median_price")


@query("i11_i13_defaults", q("""SELECT COUNT(*) AS products, COUNT(*) FILTER (WHERE NOT in_master) AS unknown, COUNT(*) FILTER (WHERE no_price) AS no_price,
    COUNT(*) FILTER (WHERE no_cost) AS no_cost, COUNT(*) FILTER (WHERE no_lead_time) AS no_lead_time FROM soldp""", o.EXPORT, o.PEXP))
def _(b: Bed) -> DataFrame:
    return b.sold.agg(F.count("*").alias("products"), F.count_if(~F.col("in_master")).alias("unknown"),
                      *[F.count_if(c).alias(c) for c in ("no_price", "no_cost", "no_lead_time")])


@query("i14_priced_sales", q(f"SELECT {o.SALES_OUT} FROM imported", o.EXPORT, o.PEXP))
def _(b: Bed) -> DataFrame:
    return im.priced_sales(b.orders, b.sold)


PLACES = "SELECT warehouse_id, warehouse_id AS warehouse_name, 'n/a' AS region FROM (SELECT warehouse_id FROM uniq UNION SELECT warehouse_id FROM istock)"


@query("i15_places", q(PLACES, o.EXPORT, o.SEXP.split(",\nunsold")[0]))
def _(b: Bed) -> DataFrame:
    return im.places(b.orders, im.stock_positions(b.stock_labels))


@query("i16_stock_positions", q(f"""SELECT warehouse_id, product_id, {B('current_stock')} AS current_stock, {B('reorder_level')} AS reorder_level, no_level
    FROM istock""", o.EXPORT, o.PEXP, o.SEXP))
def _(b: Bed) -> DataFrame:
    return im.stock_positions(b.stock_labels)


@query("i17_unsold_products", q(f"SELECT {o.PRODUCT_OUT} FROM unsold", o.EXPORT, o.PEXP, o.SEXP))
def _(b: Bed) -> DataFrame:
    return im.unsold_products(im.stock_positions(b.stock_labels), stage(b.sold, "sold-products"))


IMPORTED_POLICY = f"""levels AS (
    WITH sales AS (SELECT * FROM imported), inventory AS (SELECT * FROM istock), warehouses AS ({PLACES}),
    products AS (SELECT product_id, product_name, category, unit_cost, unit_price, lead_time_days FROM soldp
                 UNION ALL SELECT product_id, product_name, category, unit_cost, unit_price, lead_time_days FROM unsold),
    {o.REPL}
    SELECT i.warehouse_id, i.product_id, {B('i.current_stock')} AS current_stock,
           {B('CASE WHEN i.reorder_level = 0 THEN COALESCE(r.reorder_point, 0) ELSE i.reorder_level END')} AS reorder_level
    FROM istock i LEFT JOIN repl r ON r.warehouse_id = i.warehouse_id AND r.product_id = i.product_id)"""


@query("i18_recommended_levels", q("SELECT * FROM levels", o.EXPORT, o.PEXP, o.SEXP, IMPORTED_POLICY))
def _(b: Bed) -> DataFrame:
    return b.imported.tables.inventory


FINDINGS = {
    "rows_in": "SELECT COUNT(*) FROM exp", "rows_out": "SELECT COUNT(*) FROM uniq",
    "days": "SELECT MAX(order_date) - MIN(order_date) + 1 FROM uniq", "date_reading": "SELECT 0",
    "first_day": "SELECT 0", "last_day": "SELECT 0",
    "derived_prices": "SELECT COUNT(*) FROM labelled WHERE reason IS NULL AND from_amount",
    "shared_order_ids": "SELECT (SELECT COUNT(*) FROM kept) - (SELECT COUNT(*) FROM uniq)",
    **{code: f"SELECT COUNT(*) FROM soldp WHERE {test}" for code, test in (
        ("assumed_costs", "no_cost"), ("assumed_lead_times", "no_lead_time"), ("unlisted_products", "NOT in_master"), ("unpriced_products", "no_price"))},
    "unsold_products": "SELECT COUNT(*) FROM unsold", "recommended_levels": "SELECT COUNT(*) FROM istock WHERE no_level",
}
ABOUT = {"date_reading": "'format d/M/yyyy'", "first_day": "(SELECT CAST(MIN(order_date) AS VARCHAR) FROM uniq)",
         "last_day": "(SELECT CAST(MAX(order_date) AS VARCHAR) FROM uniq)"}


@query("i19_import_report", q(" UNION ALL ".join([
    "SELECT 'dropped' AS kind, reason AS code, COUNT(*) AS rows, reason AS text FROM labelled WHERE reason IS NOT NULL GROUP BY ALL",
    "SELECT 'dropped', 'invalid stock rows', COUNT(*), 'invalid stock rows' FROM slab WHERE NOT COALESCE(stock >= 0, FALSE)",
    *[f"SELECT '{imports.TEXTS[code][0]}', '{code}', {B(f'({sql})')} AS n, '{imports.TEXTS[code][1]}' || {"': ' || " + ABOUT[code] if code in ABOUT else "''"} "
      f"WHERE n > 0 OR '{code}' IN ('rows_in', 'rows_out', 'days', 'first_day', 'last_day', 'date_reading')" for code, sql in FINDINGS.items()]]), o.EXPORT, o.PEXP, o.SEXP))
def _(b: Bed) -> DataFrame:
    return b.imported.findings


PRODUCT_NAMES = ", ".join(TABLE_SCHEMAS["products"].names)
IMPORTED = {"sales": "SELECT * FROM imported", "inventory": "SELECT * FROM levels", "restocks": "SELECT * FROM restocks WHERE FALSE", "warehouses": PLACES,
            "products": f"SELECT {PRODUCT_NAMES} FROM soldp UNION ALL SELECT {PRODUCT_NAMES} FROM unsold"}


@query("i20_import_data", q(o.figures(IMPORTED, TABLE_SCHEMAS), o.EXPORT, o.PEXP, o.SEXP, IMPORTED_POLICY))
def _(b: Bed) -> DataFrame:
    return _figures(dict(b.imported.tables.items()))


STORE_ITEMS = """demand AS (SELECT day AS date, w AS store, p AS item, SUM(CASE WHEN flag <> 'R' THEN qty ELSE 0 END) AS units FROM lines GROUP BY 1, 2, 3)"""
STORE_LABELS = "'S' || CASE WHEN store < 10 THEN lpad(CAST(store AS VARCHAR), 2, '0') ELSE CAST(store AS VARCHAR) END AS warehouse_id"
ITEM_ID = "'I' || CASE WHEN item < 1000 THEN lpad(CAST(item AS VARCHAR), 3, '0') ELSE CAST(item AS VARCHAR) END"


@query("i21_store_item_sales", q(f"""SELECT 'K' || lpad(CAST(ROW_NUMBER() OVER (ORDER BY date, store, item) AS VARCHAR), 7, '0') AS order_id, date AS order_date,
    {STORE_LABELS}, {ITEM_ID} AS product_id, {B('units')} AS quantity, {D('1.0')} AS unit_price, {D('units')} AS revenue FROM demand WHERE units > 0""", STORE_ITEMS))
def _(b: Bed) -> DataFrame:
    return store_items.adapt_store_items(testbed.store_item_demand(b.spark, b.sf_dir)).sales


@query("i21_store_item_products", q(f"""SELECT DISTINCT {ITEM_ID} AS product_id, 'Item ' || substr({ITEM_ID}, 2) AS product_name,
    CASE item % 5 WHEN 0 THEN 'Beverages' WHEN 1 THEN 'Snacks' WHEN 2 THEN 'Household' WHEN 3 THEN 'Personal Care' ELSE 'Staples' END AS category,
    {D('0.75')} AS unit_cost, {D('1.0')} AS unit_price, {B('7')} AS lead_time_days FROM demand""", STORE_ITEMS))
def _(b: Bed) -> DataFrame:
    return store_items.adapt_store_items(testbed.store_item_demand(b.spark, b.sf_dir)).products


# ================================================================================================ quality
def _orphans(fact: str, dim: str, key: str) -> str:
    return f"SELECT '{fact} {dim} known' AS \"check\", COUNT(*) AS violations FROM {fact} WHERE {key} IS NULL OR {key} NOT IN (SELECT {key} FROM {dim})"


def _nulls(table: str, columns: str) -> str:
    return f"SELECT '{table} without nulls', COUNT(*) FROM {table} WHERE " + " OR ".join(f"{c} IS NULL" for c in columns.split())


def _repeats(label: str, table: str, keys: str) -> str:
    return f"SELECT '{label}', {B('COALESCE(SUM(n - 1), 0)')} FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY {keys})"


QUALITY = " UNION ALL ".join([
    *[_orphans(f, d, k) for f in ("sales", "inventory", "restocks") for d, k in (("products", "product_id"), ("warehouses", "warehouse_id"))],
    *[f"SELECT '{t} not empty', {B('CAST(COUNT(*) = 0 AS INTEGER)')} FROM {t}" for t in ("warehouses", "products", "inventory", "restocks", "sales")],
    _nulls("warehouses", "warehouse_id warehouse_name region"), _nulls("products", "product_id product_name category unit_cost unit_price lead_time_days"),
    _nulls("inventory", "warehouse_id product_id current_stock reorder_level"), _nulls("restocks", "restock_date warehouse_id product_id quantity"),
    _nulls("sales", "order_id order_date warehouse_id product_id quantity unit_price revenue"),
    _repeats("warehouses id unique", "warehouses", "warehouse_id"), _repeats("products id unique", "products", "product_id"),
    _repeats("sales order id unique", "sales", "order_id"), _repeats("inventory pair unique", "inventory", "warehouse_id, product_id"),
    *[f"SELECT '{label}', COUNT(*) FROM {t} WHERE NOT COALESCE({c}, FALSE)" for label, t, c in (
        ("products price above cost", "products", "unit_price > unit_cost"), ("inventory stock not negative", "inventory", "current_stock >= 0"),
        ("inventory reorder level not negative", "inventory", "reorder_level >= 0"), ("sales quantity positive", "sales", "quantity > 0"),
        ("sales unit price positive", "sales", "unit_price > 0"),
        ("sales revenue equals quantity times price", "sales", "ABS(quantity * unit_price - revenue) < 0.011"),
        ("sales dates plausible", "sales", "order_date > DATE '2000-01-01' AND order_date < DATE '2100-01-01'"))],
])


@query("q1_q23_quality_report", q(QUALITY))
def _(b: Bed) -> DataFrame:
    return quality.quality_report(b.t)


@query("q24_n9_load_check", q("""SELECT (SELECT COUNT(*) FROM sales) AS sales_rows,
    (SELECT COUNT(*) FROM sales WHERE revenue <> ROUND(quantity * unit_price, 2)) AS bad_revenue_rows, (SELECT COUNT(*) FROM inventory) AS inventory_rows"""))
def _(b: Bed) -> DataFrame:
    return kpis.load_check(b.t.sales, b.t.inventory)


@query("q25_stock_ledger", q(f"""SELECT warehouse_id, product_id, {B('COALESCE(received, 0)')} AS received, {B('COALESCE(sold, 0)')} AS sold, {B('COALESCE(held, 0)')} AS held,
    {B('COALESCE(received, 0) - COALESCE(sold, 0) - COALESCE(held, 0)')} AS difference
FROM (SELECT warehouse_id, product_id, SUM(quantity) AS received FROM restocks GROUP BY 1, 2)
FULL JOIN (SELECT warehouse_id, product_id, SUM(quantity) AS sold FROM sales GROUP BY 1, 2) USING (warehouse_id, product_id)
FULL JOIN (SELECT warehouse_id, product_id, SUM(current_stock) AS held FROM inventory GROUP BY 1, 2) USING (warehouse_id, product_id)"""))
def _(b: Bed) -> DataFrame:
    return quality.stock_ledger(b.t)


# ================================================================================================ KPIs
HEADLINE = f"""SELECT (SELECT {D('SUM(revenue)')} FROM sales) AS total_sales, (SELECT {B('SUM(quantity)')} FROM sales) AS units_sold,
    (SELECT {B('SUM(current_stock)')} FROM inventory) AS total_stock, (SELECT COUNT(*) FROM inventory WHERE current_stock <= reorder_level) AS low_stock_items"""


@query("k1_n1_headline", q(HEADLINE))
def _(b: Bed) -> DataFrame:
    return kpis.headline(b.added("places"), b.t.inventory)


@query("k2_n3_monthly_sales", q(o.MOM, o.MONTHLY.format("sales")))
def _(b: Bed) -> DataFrame:
    return kpis.monthly_sales(b.added("places"))


@query("k3_stock_turnover", q(f"SELECT warehouse_id, {o.TURN_OUT} FROM turn", *o.TURN))
def _(b: Bed) -> DataFrame:
    return kpis.stock_turnover(*b.receipts)


@query("k3p_product_turnover", q(f"SELECT {o.TURN_OUT} FROM turn", *o.TURNP))
def _(b: Bed) -> DataFrame:
    return kpis.stock_turnover(*b.receipts, level="product")


@query("k3v_turnover_view", q("SELECT * FROM tview", *o.VIEW))
def _(b: Bed) -> DataFrame:
    return kpis.stock_turnover_view(*b.receipts)


@query("k4_movement_classes", q("SELECT * FROM tclass", *o.VIEW))
def _(b: Bed) -> DataFrame:
    return kpis.stock_turnover_classified(*b.receipts)


@query("k5_reorder_alerts", q(f"SELECT {o.ALERT_COLUMNS} FROM alerts", o.ALERTS))
def _(b: Bed) -> DataFrame:
    return _rounded(b.alerts, 6, "daily_demand")


@query("k5v_n6_alerts_view", q(f"SELECT * EXCLUDE (severity) REPLACE ({R('daily_demand', 2)} AS daily_demand) FROM alerts", o.ALERTS))
def _(b: Bed) -> DataFrame:
    return kpis.reorder_alerts_view(*b.positions)


@query("k6_category_summary", q(f"""SELECT category, {D('revenue')} AS revenue, {D('gross_profit')} AS gross_profit, {pct('gross_profit', 'revenue')} AS margin_pct,
    {pct('revenue', '(SELECT SUM(revenue) FROM bycat)')} AS revenue_share_pct FROM bycat""", o.CATEGORY))
def _(b: Bed) -> DataFrame:
    return kpis.category_summary(b.added("products"), b.t.products)


WSUM_OUT = f"""warehouse_id, warehouse_name, region, {D('revenue')} AS revenue, {B('units')} AS units"""


@query("k7_n4_warehouse_summary", q(f"""SELECT {WSUM_OUT}, {B('COALESCE(total_stock, 0)')} AS total_stock, {B('COALESCE(skus, 0)')} AS skus,
    {B('COALESCE(low_stock_items, 0)')} AS low_stock_items FROM wsum""", o.WSUM))
def _(b: Bed) -> DataFrame:
    return kpis.warehouse_summary(b.added("places"), b.t.inventory, b.t.warehouses)


@query("k7v_warehouse_view", q(f"SELECT {WSUM_OUT}, {B('total_stock')} AS total_stock, {B('skus')} AS skus, {B('low_stock_items')} AS low_stock_items FROM wsum", o.WSUM))
def _(b: Bed) -> DataFrame:
    return kpis.warehouse_summary_view(b.t.sales, b.t.inventory, b.t.warehouses)


# ================================================================================================ analysis queries
@query("n2_top_products", q(f"""SELECT product_id, product_name, category, {B('SUM(quantity)')} AS units_sold, {D('SUM(revenue)')} AS revenue
FROM sales JOIN products USING (product_id) GROUP BY 1, 2, 3 ORDER BY SUM(revenue) DESC, product_id LIMIT 10"""))
def _(b: Bed) -> DataFrame:
    return kpis.top_products(b.added("products"), b.t.products)


@query("n5_slowest_pairs", q("""SELECT warehouse_id, product_id, product_name, current_stock, stock_turnover, days_of_inventory, movement_class
FROM tclass ORDER BY stock_turnover ASC NULLS LAST, warehouse_id, product_id LIMIT 10""", *o.VIEW))
def _(b: Bed) -> DataFrame:
    return kpis.slowest_pairs(*b.receipts)


@query("n7_category_performance", q(f"""SELECT category, {D('ROUND(revenue, 0)')} AS revenue, {pct('revenue', '(SELECT SUM(revenue) FROM bycat)')} AS revenue_share_pct,
    {pct('gross_profit', 'revenue')} AS margin_pct FROM bycat""", o.CATEGORY))
def _(b: Bed) -> DataFrame:
    return kpis.category_performance(b.t.sales, b.t.products)


@query("n8_transfer_candidates", q(f"""SELECT d.product_id, s.warehouse_id AS from_wh, d.warehouse_id AS to_wh, {B('LEAST(s.surplus, d.deficit)')} AS transfer_qty
FROM stat d JOIN stat s ON s.product_id = d.product_id AND s.warehouse_id <> d.warehouse_id WHERE d.deficit > 0 AND s.surplus > 0
ORDER BY LEAST(s.surplus, d.deficit) DESC, s.surplus DESC, d.deficit DESC, d.product_id, s.warehouse_id, d.warehouse_id LIMIT 20""",
                                 "stat AS (SELECT *, current_stock - 2 * reorder_level AS surplus, reorder_level - current_stock AS deficit FROM inventory)"))
def _(b: Bed) -> DataFrame:
    return transfers.transfer_candidates(b.t.inventory)


@query("n10_warehouse_month", q(f"""SELECT {D('SUM(revenue)')} AS revenue FROM sales
WHERE warehouse_id = '3' AND order_date >= DATE '1998-05-01' AND order_date < DATE '1998-06-01'"""))
def _(b: Bed) -> DataFrame:
    return kpis.warehouse_month(b.t.sales, "3", 1998, 5)


@query("n10_pruned_month_read", q(f"""SELECT warehouse_id, {D('SUM(revenue)')} AS revenue, COUNT(*) AS row_count FROM sales
WHERE order_date BETWEEN DATE '1998-05-01' AND DATE '1998-05-31' GROUP BY 1"""))
def _(b: Bed) -> DataFrame:
    s = files.read_sales_between(b.spark, b.written(), "1998-05-01", "1998-05-31")
    return s.groupBy("warehouse_id").agg(F.sum("revenue").alias("revenue"), F.count("*").alias("row_count"))


@query("n11_product_days", q(f"SELECT order_date, {B('SUM(quantity)')} AS units FROM sales WHERE product_id = '1' GROUP BY 1"))
def _(b: Bed) -> DataFrame:
    return kpis.product_days(b.t.sales, "1")


@query("n12_top_product_ids", q(f"SELECT product_id, {D('SUM(revenue)')} AS revenue FROM sales GROUP BY 1 ORDER BY SUM(revenue) DESC, product_id LIMIT 10"))
def _(b: Bed) -> DataFrame:
    return kpis.top_product_ids(b.added("products"))


# ================================================================================================ models
@query("a1_monthly_daily_rate", q(f"SELECT product_id, month, {R('rate', 6)} AS units_per_day FROM rates", o.RATES))
def _(b: Bed) -> DataFrame:
    return _rounded(segments.monthly_daily_rate(b.t.sales), 6, "units_per_day")


@query("a2_abc_xyz", q("SELECT * FROM abc", o.RATES, o.ABC))
def _(b: Bed) -> DataFrame:
    return b.abc


@query("a3_daily_matrix", q(f"""SELECT product_id, COUNT(*) AS days, COUNT(*) FILTER (WHERE units = 0) AS empty_days, {B('SUM(units)')} AS units, {B('MAX(units)')} AS most,
    MIN(day) AS first_day, MAX(day) AS last_day FROM dense GROUP BY 1""", o.DENSE))
def _(b: Bed) -> DataFrame:
    return demand.daily_matrix(b.t.sales).groupBy("product_id").agg(
        F.count("*").alias("days"), F.count_if(F.col("units") == 0).alias("empty_days"), F.sum("units").alias("units"), F.max("units").alias("most"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("a4_forecast", q(f"SELECT product_id, day, {R('units', 4)} AS units FROM fc", o.forecast_sql(30, 0)))
def _(b: Bed) -> DataFrame:
    return _rounded(forecast.forecast(b.t.sales, 30, b.t.products), 4, "units")


@query("a4_forecast_per_product", q(f"SELECT product_id, day, {R('units', 4)} AS units FROM fc", o.forecast_sql(14, 0, pooled=False)))
def _(b: Bed) -> DataFrame:
    return _rounded(forecast.forecast(b.t.sales, 14), 4, "units")


@query("a5_backtest", q(o.BACKTEST, o.backtest_sql(30)))
def _(b: Bed) -> DataFrame:
    return forecast.backtest(b.t.sales, 30, b.t.products)


SHORT = "CAST(order_date AS DATE) <= (SELECT MIN(order_date) FROM all_sales) + {days}"


@query("a5_short_history", q(f"""SELECT * FROM (WITH sales AS (SELECT * FROM all_sales WHERE {SHORT.format(days=44)}),
{o.backtest_sql(30)} {o.BACKTEST})""", "all_sales AS (SELECT * FROM sales)"))
def _(b: Bed) -> DataFrame:
    first = b.t.sales.agg(F.min("order_date")).scalar()
    return forecast.backtest(b.t.sales.filter(F.col("order_date") <= F.date_add(first, 44)), 30, b.t.products)


@query("a5p_backtest_per_product", q(f"""SELECT product_id, {R('SUM(ABS(a - m)) / NULLIF(SUM(a), 0)', 4)} AS wape_model,
    {R('SUM(ABS(a - v)) / NULLIF(SUM(a), 0)', 4)} AS wape_naive FROM errs GROUP BY 1""", o.backtest_sql(30)))
def _(b: Bed) -> DataFrame:
    return _rounded(forecast.backtest_per_product(b.t.sales, 30, b.t.products), 4, "wape_model", "wape_naive")


@query("a6_demand_stats", q(f"SELECT warehouse_id, product_id, {R('mean_daily', 6)} AS mean_daily, {R('std_daily', 6)} AS std_daily FROM stats", o.STATS))
def _(b: Bed) -> DataFrame:
    return _rounded(demand.demand_stats(b.t.sales), 6, "mean_daily", "std_daily")


@query("a7_a9_replenishment", q(o.REPL_OUT, o.REPL))
def _(b: Bed) -> DataFrame:
    return b.repl


@query("a10_transfer_suggestions", q("SELECT * FROM transfers", o.REPL, o.TRANSFERS))
def _(b: Bed) -> DataFrame:
    return b.transfers


@query("a11_inventory_health", q("SELECT * FROM health", o.REPL, o.DEAD, o.HEALTH))
def _(b: Bed) -> DataFrame:
    return health.inventory_health(b.t.sales, b.repl)


@query("a11_dead_stock", q(o.REPL_OUT.replace("FROM repl", "FROM dead"), o.REPL, o.DEAD))
def _(b: Bed) -> DataFrame:
    return health.dead_stock(b.t.sales, b.repl)


@query("a12_delay_curve", q(f"""SELECT {B('extra')} AS supplier_delay_days, {D('SUM(suggested_order_cost)')} AS purchase_order_value,
    COUNT(*) FILTER (WHERE stockout_risk_pct >= 50) AS items_at_risk FROM curve GROUP BY 1""",
                           o.policy_sql(name="curve", delays="(VALUES (0), (3), (7), (14), (21)) AS v(extra)")))
def _(b: Bed) -> DataFrame:
    return replenish.delay_curve(*b.positions)


WHAT_IF = Policy(z=2.33, ordering_cost=80.0, holding_rate=0.3, lead_time_extra_days=10.0)


@query("a13_what_if", q(f"""SELECT warehouse_id, product_id, lead_time_days, safety_stock, reorder_point, eoq, order_up_to, below_rop, suggested_order_qty,
    {D('suggested_order_cost')} AS suggested_order_cost, stockout_risk_pct FROM what""", o.policy_sql("2.33", "80.0", "0.3", "10.0", "what")))
def _(b: Bed) -> DataFrame:
    r = replenish.replenishment(*b.positions, policy=WHAT_IF)
    return r.select(*PAIR, "lead_time_days", "safety_stock", "reorder_point", "eoq", "order_up_to", "below_rop", "suggested_order_qty",
                    "suggested_order_cost", "stockout_risk_pct")


@query("a13_health_under_delay", q("SELECT * FROM health", o.policy_sql(extra="14.0"), o.DEAD, o.HEALTH))
def _(b: Bed) -> DataFrame:
    return health.inventory_health(b.t.sales, replenish.replenishment(*b.positions, policy=Policy(lead_time_extra_days=14.0)))


@query("a13_service_level", q(f"""SELECT warehouse_id, product_id, safety_stock, reorder_point, order_up_to, suggested_order_qty,
    {D('suggested_order_cost')} AS suggested_order_cost FROM repl""", o.policy_sql("1.959963984540054")))
def _(b: Bed) -> DataFrame:
    r = replenish.replenishment(*b.positions, policy=Policy(z=replenish.z_for(0.975)))
    return r.select(*PAIR, "safety_stock", "reorder_point", "order_up_to", "suggested_order_qty", "suggested_order_cost")


# ================================================================================================ served reads
@query("h1_health_counts", q("""SELECT (SELECT COUNT(*) FROM sales) AS sales_rows, (SELECT COUNT(*) FROM products) AS products,
    (SELECT COUNT(*) FROM warehouses) AS warehouses"""))
def _(b: Bed) -> DataFrame:
    return served.health_counts(b.t)


@query("h2_filtered_kpis", q(HEADLINE.replace("FROM sales)", "FROM s)").replace("FROM inventory", "FROM i"),
                             "s AS (SELECT s.* FROM sales s JOIN products USING (product_id) WHERE category = 'LARGE' AND warehouse_id = '3')",
                             "i AS (SELECT i.* FROM inventory i JOIN products USING (product_id) WHERE category = 'LARGE' AND warehouse_id = '3')"))
def _(b: Bed) -> DataFrame:
    return served.kpis_of(b.t, "3", "LARGE")


@query("h2_nothing_sold", q("""SELECT 0.0 AS total_sales, 0 AS units_sold, CAST(SUM(current_stock) AS BIGINT) AS total_stock,
    COUNT(*) FILTER (WHERE current_stock <= reorder_level) AS low_stock_items FROM inventory WHERE warehouse_id = '3'"""))
def _(b: Bed) -> DataFrame:
    return served.kpis_of(b.t.with_(sales=b.t.sales.filter("order_date < DATE '1900-01-01'")), "3")


@query("h3_alerts", q(f"""SELECT {o.ALERT_COLUMNS}, (SELECT COUNT(*) FROM alerts WHERE severity = 'Low' AND warehouse_id = '3') AS count
FROM alerts WHERE severity = 'Low' AND warehouse_id = '3' ORDER BY {o.URGENT} LIMIT 100""", o.ALERTS))
def _(b: Bed) -> DataFrame:
    return _rounded(served.alerts_of(b.t, "3", "Low"), 6, "daily_demand")


@query("h4_replenishment", q(f"""
SELECT * REPLACE ({D('suggested_order_cost')} AS suggested_order_cost, {D('excess_value')} AS excess_value, {D('stock_value')} AS stock_value),
    (SELECT COUNT(*) FROM repl WHERE below_rop) AS count, (SELECT {D('SUM(suggested_order_cost)')} FROM repl WHERE below_rop) AS total_cost
FROM repl WHERE below_rop ORDER BY repl.suggested_order_cost DESC, warehouse_id, product_id LIMIT 100""", o.REPL))
def _(b: Bed) -> DataFrame:
    return served.replenishment_of(b.repl)


@query("h5_transfers", q("""SELECT *, (SELECT COUNT(*) FROM transfers) AS count FROM transfers
ORDER BY value_at_cost DESC, product_id, from_warehouse, to_warehouse LIMIT 100""", o.REPL, o.TRANSFERS))
def _(b: Bed) -> DataFrame:
    return served.transfers_of(b.transfers)


@query("h6_segment", q("""SELECT *, (SELECT COUNT(*) FROM abc WHERE segment = 'AZ') AS count FROM abc WHERE segment = 'AZ'
ORDER BY revenue DESC, product_id LIMIT 1000""", o.RATES, o.ABC))
def _(b: Bed) -> DataFrame:
    return served.segment_of(b.t, "AZ")


@query("h7_product_forecast", q(f"""SELECT product_id, day, {R('units', 2)} AS units, {R('(SELECT SUM(units) FROM fc WHERE product_id = (SELECT product_id FROM best))', 1)} AS total_units
FROM fc WHERE product_id = (SELECT product_id FROM best)""", o.forecast_sql(30, 0),
                               "best AS (SELECT product_id FROM sales GROUP BY 1 ORDER BY SUM(CASE WHEN order_date > (SELECT MAX(order_date) FROM sales) - 28 THEN quantity ELSE 0 END) DESC, product_id LIMIT 1)"))
def _(b: Bed) -> DataFrame:
    recent_units = F.coalesce(F.sum(F.when(F.col("order_date") > F.date_sub(months.last_day(b.t.sales), 28), F.col("quantity"))), F.lit(0))
    best = b.t.sales.groupBy("product_id").agg(recent_units.alias("u")).orderBy(F.desc("u"), "product_id").first()["product_id"]
    return forecast.product_forecast(b.t.sales, b.t.products, best)


@query("h7_forecast_with_check", q(f"""SELECT * FROM
(WITH {o.forecast_sql(30, 0)} SELECT product_id, day, {R('units', 2)} AS units FROM fc WHERE product_id = '1'),
(WITH {o.backtest_sql(30)} {o.BACKTEST})"""))
def _(b: Bed) -> DataFrame:
    return served.forecast_with_check(b.t, "1").drop("total_units")


@query("h8_product_policy", q(o.REPL_OUT + " WHERE product_id = '1'", o.REPL))
def _(b: Bed) -> DataFrame:
    return served.product_profile(b.t, b.repl, "1")["by_warehouse"]


@query("h8_product_master", q(f"SELECT {o.PRODUCT_OUT} FROM products WHERE product_id = '1'"))
def _(b: Bed) -> DataFrame:
    return served.product_profile(b.t, b.repl, "1")["product"]


@query("h8_product_segment", q("SELECT * FROM abc WHERE product_id = '1'", o.RATES, o.ABC))
def _(b: Bed) -> DataFrame:
    return served.product_profile(b.t, b.repl, "1")["abc_xyz"]


@query("h9_warehouse_months", q(o.MOM, "mine AS (SELECT * FROM sales WHERE warehouse_id = '3')", o.MONTHLY.format("mine")))
def _(b: Bed) -> DataFrame:
    return served.monthly_of(b.t.with_(sales=b.added("places")), "3")


# ================================================================================================ dashboard
CHOSEN = """chosen AS (SELECT s.* FROM sales s JOIN products USING (product_id) WHERE warehouse_id IN ('1', '2', '3') AND category IN ('LARGE', 'SMALL')
    AND order_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')"""


@query("p1_multi_filter", q(f"SELECT warehouse_id, COUNT(*) AS row_count, {B('SUM(quantity)')} AS units, {D('SUM(revenue)')} AS revenue FROM chosen GROUP BY 1", CHOSEN))
def _(b: Bed) -> DataFrame:
    s = ms.filter_tables(b.t, ms.Filters(["1", "2", "3"], ["LARGE", "SMALL"], "1997-01-01", "1999-12-31")).sales
    return s.groupBy("warehouse_id").agg(F.count("*").alias("row_count"), F.sum("quantity").alias("units"), F.sum("revenue").alias("revenue"))


@query("p2_top_names", q(f"""SELECT product_name, {B('SUM(quantity)')} AS units, {D('SUM(revenue)')} AS revenue FROM sales JOIN products USING (product_id)
GROUP BY 1 ORDER BY SUM(revenue) DESC, product_name LIMIT 10"""))
def _(b: Bed) -> DataFrame:
    return su.top_product_names(b.t.sales, b.t.products)


@query("p3_segment_summary", q(f"SELECT segment, COUNT(*) AS products, {R('SUM(revenue)', 2)} AS revenue FROM abc GROUP BY 1", o.RATES, o.ABC))
def _(b: Bed) -> DataFrame:
    return segments.segment_summary(b.abc)


@query("p4_recent_history", q(f"""SELECT product_id, day, {B('units')} AS units,
    {R('CASE WHEN COUNT(*) OVER w >= 7 THEN AVG(units) OVER w END', 4)} AS moving_avg FROM dense WHERE day > (SELECT hi FROM bounds) - 120
WINDOW w AS (PARTITION BY product_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", o.DENSE))
def _(b: Bed) -> DataFrame:
    return _rounded(demand.recent_history(b.t.sales), 4, "moving_avg")


@query("p4_smoothed_forecast", q(f"""SELECT product_id, day, {R('units', 4)} AS units,
    {R('AVG(units) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 4)} AS moving_avg FROM fc""", o.forecast_sql(30, 0)))
def _(b: Bed) -> DataFrame:
    return _rounded(forecast.smoothed_forecast(b.t.sales, 30, b.t.products), 4, "units", "moving_avg")


@query("p5_forecast_totals", q(f"""SELECT product_id, {R('f', 1)} AS forecast_units, {B('COALESCE(u, 0)')} AS last_30_units, {R('f / greatest(COALESCE(u, 0), 1) - 1', 4)} AS change
FROM (SELECT product_id, SUM(units) AS f FROM fc GROUP BY 1)
LEFT JOIN (SELECT product_id, SUM(quantity) AS u FROM sales WHERE order_date > (SELECT MAX(order_date) FROM sales) - 30 GROUP BY 1) USING (product_id)""", o.forecast_sql(30, 0)))
def _(b: Bed) -> DataFrame:
    return forecast.forecast_totals(b.t.sales, 30, b.t.products)


@query("p6_order_summary", q(f"""SELECT COUNT(*) FILTER (WHERE below_rop AND suggested_order_qty > 0) AS orders,
    {D('COALESCE(SUM(suggested_order_cost) FILTER (WHERE below_rop), 0)')} AS order_cost,
    {R('AVG(CASE WHEN policy_gap > 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100', 1)} AS level_too_low_pct FROM repl""", o.REPL))
def _(b: Bed) -> DataFrame:
    return replenish.order_summary(b.repl)


@query("p7_excess_by_category", q(f"SELECT category, {D('SUM(excess_value)')} AS excess_value FROM repl GROUP BY 1", o.REPL))
def _(b: Bed) -> DataFrame:
    return replenish.excess_by_category(b.repl)


EXCESS_COLUMNS = f"warehouse_name, product_id, product_name, current_stock, order_up_to, excess_units, {D('excess_value')} AS excess_value, days_of_cover"


@query("p7_largest_excess", q(f"SELECT {EXCESS_COLUMNS} FROM repl ORDER BY repl.excess_value DESC, warehouse_id, product_id LIMIT 15", o.REPL))
def _(b: Bed) -> DataFrame:
    return su.largest_excess(b.repl)


@query("p8_risk_histogram", q("SELECT LEAST(floor(stockout_risk_pct / 5.0::DOUBLE), 19) * 5.0::DOUBLE AS risk_from_pct, COUNT(*) AS positions FROM repl GROUP BY 1", o.REPL))
def _(b: Bed) -> DataFrame:
    return replenish.risk_histogram(b.repl)


@query("p9_named_transfers", q("""SELECT f.warehouse_name AS from_warehouse, t.warehouse_name AS to_warehouse, x.product_id, x.product_name, x.quantity, x.value_at_cost
FROM transfers x JOIN products p USING (product_id) JOIN warehouses f ON f.warehouse_id = x.from_warehouse JOIN warehouses t ON t.warehouse_id = x.to_warehouse
WHERE p.category IN ('LARGE', 'SMALL') AND x.from_warehouse <> '9' AND x.to_warehouse <> '9'""", o.REPL, o.TRANSFERS))
def _(b: Bed) -> DataFrame:
    chosen = [str(i) for i in range(25) if i != 9]
    return su.named_transfers(b.transfers, b.t.warehouses, b.t.products, chosen, ["LARGE", "SMALL"])


def _extremes(keys: str) -> str:
    pick = f"SELECT {keys}, product_name, stock_turnover, '{{}}' AS side FROM turn WHERE stock_turnover IS NOT NULL ORDER BY stock_turnover {{}}, {keys} LIMIT 10"
    return f"(SELECT * FROM ({pick.format('fastest', 'DESC')})) UNION ALL (SELECT * FROM ({pick.format('slowest', 'ASC')}))"


@query("p10_pair_extremes", q(_extremes("warehouse_id, product_id"), *o.TURN))
def _(b: Bed) -> DataFrame:
    return su.turnover_extremes(kpis.turnover_base(*b.receipts), PAIR)


@query("p10_product_extremes", q(_extremes("product_id"), *o.TURNP))
def _(b: Bed) -> DataFrame:
    return su.turnover_extremes(kpis.turnover_base(*b.receipts, level="product"), ["product_id"])


@query("p11_sales_headline", q(f"SELECT {D('SUM(revenue)')} AS total_sales, {B('SUM(quantity)')} AS units_sold, COUNT(DISTINCT product_id) AS skus_sold FROM sales"))
def _(b: Bed) -> DataFrame:
    return kpis.sales_headline(b.t.sales)


@query("p12_enough_history", q("SELECT COUNT(DISTINCT order_date) AS sale_days, COUNT(DISTINCT order_date) > 90 AS can_check FROM sales"))
def _(b: Bed) -> DataFrame:
    return forecast.enough_history(b.t.sales)


# ================================================================================================ action pack
LABELS = (("stock_value", "Stock value at cost"), ("excess_value", "Excess stock value"), ("excess_pct", "Excess share of stock value %"),
          ("dead_stock_items", "Dead stock items"), ("dead_stock_value", "Dead stock value"), ("at_risk_items", "Items with stockout risk of 50% or more"),
          ("median_days_of_cover", "Median days of cover"), ("suggested_po_value", "Suggested purchase order value"))


@query("r1_health_rows", q(" UNION ALL ".join(f"SELECT '{label}' AS label, {D(c)} AS value FROM health" for c, label in LABELS), o.REPL, o.DEAD, o.HEALTH))
def _(b: Bed) -> DataFrame:
    return su.health_rows(health.inventory_health(b.t.sales, b.repl))


def _pack(b: Bed, sheet: str) -> DataFrame:
    return su.action_pack(b.repl, b.spark.range(1).select(*[F.lit(0.0).alias(c) for c, _ in LABELS]), b.abc if sheet == "abc_xyz" else b.t.products.select(
        "*", *[F.lit(None).alias(c) for c in ("revenue", "revenue_share_pct", "abc", "demand_cv", "xyz", "segment")]), b.transfers)[sheet]


@query("r2_orders_to_place", q(f"""SELECT warehouse_name, product_id, product_name, current_stock, reorder_point, eoq, suggested_order_qty,
    {D('suggested_order_cost')} AS suggested_order_cost, stockout_risk_pct, lead_time_days FROM repl WHERE below_rop""", o.REPL))
def _(b: Bed) -> DataFrame:
    return _pack(b, "orders_to_place")


@query("r3_stockout_risk", q("""SELECT warehouse_name, product_id, product_name, current_stock, mean_daily, lead_time_days, stockout_risk_pct, days_of_cover
FROM repl WHERE stockout_risk_pct >= 50""", o.REPL))
def _(b: Bed) -> DataFrame:
    return _pack(b, "stockout_risk")


@query("r4_transfers", q("SELECT * FROM transfers", o.REPL, o.TRANSFERS))
def _(b: Bed) -> DataFrame:
    return _pack(b, "transfers")


@query("r5_excess_stock", q(f"SELECT {EXCESS_COLUMNS} FROM repl WHERE repl.excess_value > 0", o.REPL))
def _(b: Bed) -> DataFrame:
    return _pack(b, "excess_stock")


@query("r6_abc_xyz", q("SELECT product_id, product_name, category, revenue, revenue_share_pct, abc, demand_cv, xyz, segment FROM abc", o.RATES, o.ABC))
def _(b: Bed) -> DataFrame:
    return _pack(b, "abc_xyz")


DIGEST = f"""SELECT 'Positions due: ' || n || '; Stockout ' || s || '; Critical ' || c || '; Low ' || l || chr(10) || body
    || CASE WHEN n > 15 THEN chr(10) || 'Further positions: ' || (n - 15) ELSE '' END AS message
FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE severity = 'Stockout') AS s, COUNT(*) FILTER (WHERE severity = 'Critical') AS c,
             COUNT(*) FILTER (WHERE severity = 'Low') AS l FROM alerts),
     (SELECT string_agg(line, chr(10) ORDER BY rn) AS body FROM (
        SELECT rn, format('[{{}}] {{}}, {{}}: {{}} on hand (level {{}}), {{}}, delivery takes {{}}', severity, warehouse_name, product_name, current_stock, reorder_level,
            COALESCE('lasts ' || regexp_replace(CAST(days_of_stock_left AS VARCHAR), '\\.0$', '') || ' days', 'no recent sales'), lead_time_days) AS line
        FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {o.URGENT}) AS rn FROM alerts) WHERE rn <= 15))"""


@query("r7_alert_digest", q(DIGEST, o.ALERTS))
def _(b: Bed) -> DataFrame:
    return su.alert_digest(b.alerts)


# ================================================================================================ measures
@query("m1_m4_sales_measures", q(o.sales_measures("p.category, CAST(year(order_date) AS BIGINT) AS year", "1, 2")))
def _(b: Bed) -> DataFrame:
    return _rounded(ms.sales_by(b.t.with_(sales=b.added("pairs")), ["category", "year"]), 6, "gross_margin")


@query("m1_m4_by_warehouse_product_name", q(o.sales_measures("warehouse_name, product_name", "1, 2")))
def _(b: Bed) -> DataFrame:
    return _rounded(ms.sales_by(b.t, ["warehouse_name", "product_name"]), 6, "gross_margin")


YOY = R(f"{D('COALESCE(total_sales, 0) - sales_ly')} / NULLIF({D('sales_ly')}, 0)", 6)
LY_OUT = f"SELECT * REPLACE ({D('total_sales')} AS total_sales, {D('sales_ly')} AS sales_ly), {YOY} AS sales_yoy FROM lys"


@query("m5_m6_sales_last_year", q(LY_OUT, o.last_year_sql("warehouse_name", "month")))
def _(b: Bed) -> DataFrame:
    return _rounded(ms.sales_last_year(b.t, ["warehouse_name"]), 6, "sales_yoy")


@query("m5_sales_last_year_daily", q(LY_OUT, o.last_year_sql("category", "day")))
def _(b: Bed) -> DataFrame:
    return _rounded(ms.sales_last_year(b.t, ["category"], grain="day"), 6, "sales_yoy")


@query("m5_last_year_in_1996", q(f"SELECT warehouse_name, strftime(period, '%b %Y') AS month, {D('sales_ly')} AS sales_ly FROM lys",
                                 o.last_year_sql("warehouse_name", "month", "DATE '1996-01-01'", "DATE '1996-12-31'")))
def _(b: Bed) -> DataFrame:
    return ms.measure(b.t, "sales_ly", ["warehouse_name", "month"], ms.Filters(first_day="1996-01-01", last_day="1996-12-31"))


@query("m5_by_year", q(f"SELECT CAST(year(period) AS BIGINT) AS year, category, {YOY} AS sales_yoy FROM lys", o.last_year_sql("category", "year")))
def _(b: Bed) -> DataFrame:
    return _rounded(ms.measure(b.t, "sales_yoy", ["year", "category"]), 6, "sales_yoy")


@query("m5_only_last_year", q(f"SELECT product_id, period, {D('sales_ly')} AS sales_ly, {YOY} AS sales_yoy FROM lys WHERE total_sales IS NULL",
                              o.last_year_sql("product_id", "month")))
def _(b: Bed) -> DataFrame:
    rows = ms.sales_last_year(b.t, ["product_id"]).filter("total_sales IS NULL")
    return _rounded(rows.select("product_id", "period", "sales_ly", "sales_yoy"), 6, "sales_yoy")


@query("m7_revenue_rank", q(f"""SELECT product_name, {D('s')} AS total_sales, RANK() OVER (ORDER BY s DESC) AS revenue_rank
FROM (SELECT product_name, SUM(revenue) AS s FROM sales JOIN products USING (product_id) GROUP BY 1)"""))
def _(b: Bed) -> DataFrame:
    return ms.revenue_rank(b.t)


NAMES = "names AS (SELECT product_name, SUM(revenue) AS s FROM sales JOIN products USING (product_id) GROUP BY 1)"


@query("m7_in_category", q("""SELECT product_name, r AS revenue_rank FROM (SELECT product_name, RANK() OVER (ORDER BY s DESC) AS r FROM names)
WHERE product_name IN (SELECT product_name FROM products WHERE category IN ('LARGE', 'SMALL'))""", NAMES))
def _(b: Bed) -> DataFrame:
    return ms.measure(b.t, "revenue_rank", ["product_name"], ms.Filters(categories=["LARGE", "SMALL"]))


@query("m7_by_warehouse_and_category", q("""SELECT warehouse_name, category, 1 + (SELECT COUNT(*) FROM names WHERE names.s > g.s) AS revenue_rank
FROM (SELECT warehouse_name, category, SUM(revenue) AS s FROM sales JOIN products USING (product_id) JOIN warehouses USING (warehouse_id) GROUP BY 1, 2) g""",
                                         NAMES))
def _(b: Bed) -> DataFrame:
    return ms.measure(b.t, "revenue_rank", ["warehouse_name", "category"])


SM_OUT = f"""total_stock, reorder_level, opening_stock, units_sold, low_stock_items, {R('average_stock', 6)} AS average_stock, {R('stock_turnover', 6)} AS stock_turnover,
    {B('days_in_period')} AS days_in_period, {R('days_in_period / NULLIF(stock_turnover, 0)', 6)} AS days_of_inventory, reorder_status, {B('shortfall')} AS shortfall"""
SM_DIGITS = ("average_stock", "stock_turnover", "days_of_inventory")


@query("m8_m16_stock_measures", q(f"SELECT warehouse_name, {SM_OUT} FROM sm", o.STOCKM, o.stock_measures("warehouse_name")))
def _(b: Bed) -> DataFrame:
    return _rounded(ms.stock_by(b.t, ["warehouse_name"]), 6, *SM_DIGITS)


@query("m8_m16_by_product", q(f"SELECT product_id, category, {SM_OUT} FROM sm", o.STOCKM, o.stock_measures("product_id, category")))
def _(b: Bed) -> DataFrame:
    return _rounded(ms.stock_by(b.t, ["product_id", "category"]), 6, *SM_DIGITS)


@query("m10_filtered_opening", q(f"""SELECT warehouse_name, {B('opening_stock')} AS opening_stock FROM sm""", o.STOCKM.replace(
    "SELECT * FROM inventory FULL JOIN", "SELECT * FROM (SELECT * FROM inventory WHERE product_id IN (SELECT product_id FROM products WHERE category = 'LARGE')) i FULL JOIN").replace(
    "opened USING", "(SELECT * FROM opened WHERE product_id IN (SELECT product_id FROM products WHERE category = 'LARGE')) o USING").replace(
    "soldu USING", "(SELECT * FROM soldu WHERE product_id IN (SELECT product_id FROM products WHERE category = 'LARGE')) s USING"), o.stock_measures("warehouse_name")))
def _(b: Bed) -> DataFrame:
    return ms.measure(b.t, "opening_stock", ["warehouse_name"], ms.Filters(categories=["LARGE"]))


@query("m17_movement_class", q(f"""SELECT product_id, {R('stock_turnover', 6)} AS stock_turnover,
    CASE WHEN COALESCE(stock_turnover, 0) >= p75 THEN 'Fast' WHEN COALESCE(stock_turnover, 0) <= p25 THEN 'Slow' ELSE 'Medium' END AS movement_class
FROM sm, (SELECT quantile_cont(stock_turnover, 0.75) AS p75, quantile_cont(stock_turnover, 0.25) AS p25 FROM sm)""", o.STOCKM, o.stock_measures("product_id")))
def _(b: Bed) -> DataFrame:
    return _rounded(ms.movement_class(b.t), 6, "stock_turnover")


@query("m17_in_category", q("""SELECT product_id,
    CASE WHEN COALESCE(stock_turnover, 0) >= p75 THEN 'Fast' WHEN COALESCE(stock_turnover, 0) <= p25 THEN 'Slow' ELSE 'Medium' END AS movement_class
FROM sm JOIN products USING (product_id), (SELECT quantile_cont(stock_turnover, 0.75) AS p75, quantile_cont(stock_turnover, 0.25) AS p25 FROM sm)
WHERE category = 'LARGE'""", o.STOCKM, o.stock_measures("product_id")))
def _(b: Bed) -> DataFrame:
    return ms.measure(b.t, "movement_class", ["product_id"], ms.Filters(categories=["LARGE"]))


@query("m18_dim_date", q("""SELECT CAST(day AS DATE) AS date, CAST(year(day) AS BIGINT) AS year, CAST(month(day) AS BIGINT) AS month_no, strftime(day, '%b %Y') AS month,
    CAST(year(day) * 100 + month(day) AS BIGINT) AS month_sort FROM cal""", o.DENSE))
def _(b: Bed) -> DataFrame:
    return ms.dim_date(b.t.sales)


@query("m19_turnover_extremes", q(" UNION ALL ".join(f"""(SELECT product_name, {R('stock_turnover', 6)} AS stock_turnover, '{side}' AS side FROM sm
WHERE sm.stock_turnover IS NOT NULL ORDER BY sm.stock_turnover {way}, product_name LIMIT 10)""" for side, way in (("fastest", "DESC"), ("slowest", "ASC"))),
                                 o.STOCKM, o.stock_measures("product_name")))
def _(b: Bed) -> DataFrame:
    return _rounded(ms.turnover_extremes(b.t), 6, "stock_turnover")


@query("m20_reorder_table", q(f"""SELECT warehouse_name, product_name, {B('SUM(current_stock)')} AS current_stock, {B('SUM(reorder_level)')} AS reorder_level,
    {B('MAX(lead_time_days)')} AS lead_time_days, {B('greatest(0, SUM(reorder_level) - SUM(current_stock))')} AS shortfall
FROM inventory JOIN products USING (product_id) JOIN warehouses USING (warehouse_id) GROUP BY 1, 2 HAVING SUM(current_stock) <= SUM(reorder_level)"""))
def _(b: Bed) -> DataFrame:
    return ms.reorder_table(b.t)


@query("m21_monthly_line", q(f"""SELECT strftime(order_date, '%b %Y') AS month, CAST(year(order_date) * 100 + month(order_date) AS BIGINT) AS month_sort, {D('SUM(revenue)')} AS total_sales
FROM sales JOIN products USING (product_id) GROUP BY 1, 2"""))
def _(b: Bed) -> DataFrame:
    return ms.measure(b.t, "total_sales", ["month", "month_sort"])


@query("m21_sales_by_warehouse", q(f"SELECT warehouse_name, {D('SUM(revenue)')} AS total_sales FROM sales JOIN products USING (product_id) JOIN warehouses USING (warehouse_id) GROUP BY 1"))
def _(b: Bed) -> DataFrame:
    return ms.measure(b.t, "total_sales", ["warehouse_name"])


# ================================================================================================ spreadsheet
@query("x1_sales_data", q(f"""SELECT order_id, order_date, CAST(year(order_date) AS BIGINT) AS year, CAST(date_trunc('month', order_date) AS DATE) AS month,
    warehouse_name AS warehouse, product_id, product_name, category, {B('quantity')} AS quantity, {D('s.unit_price')} AS unit_price, {D('revenue')} AS revenue
FROM sales s JOIN products p USING (product_id) JOIN warehouses USING (warehouse_id)"""))
def _(b: Bed) -> DataFrame:
    return su.sales_data(*b.sw)


YEARS = [str(y) for y in range(1995, 2002)] + ["Grand Total"]


@query("x2_category_by_year", q("SELECT category, " + ", ".join(f"""SUM(CASE WHEN year = '{y}' THEN revenue END) AS "{y}\"""" for y in YEARS) + f""",
    {R("SUM(CASE WHEN year = 'Grand Total' THEN revenue END) * 100 / (SELECT revenue FROM cubed WHERE category = 'Grand Total' AND year = 'Grand Total')", 1)} AS share_pct
FROM cubed GROUP BY 1""", o.cube_sql("category", "year")))
def _(b: Bed) -> DataFrame:
    return su.category_by_year(*b.sw)


@query("x3_monthly_sheet", q(f"SELECT month, {D('revenue')} AS revenue, {B('units')} AS units FROM monthly", o.MONTHLY.format("sales")))
def _(b: Bed) -> DataFrame:
    return su.monthly_sheet(b.t.sales)


@query("x4_warehouse_sheet", q(f"""SELECT warehouse_name, region, {D('revenue')} AS revenue, {B('units')} AS units,
    {B('COALESCE(low_stock_items, 0)')} AS positions_to_reorder FROM wsum""", o.WSUM))
def _(b: Bed) -> DataFrame:
    return su.warehouse_sheet(b.t.sales, b.t.inventory, b.t.warehouses)


@query("x5_inventory_sheet", q(f"""SELECT warehouse_name, product_id, product_name, {B('current_stock')} AS current_stock, {B('reorder_level')} AS reorder_level,
    CASE WHEN current_stock <= reorder_level THEN 'REORDER' ELSE 'OK' END AS status FROM inventory JOIN products USING (product_id) JOIN warehouses USING (warehouse_id)"""))
def _(b: Bed) -> DataFrame:
    return su.inventory_sheet(b.t.inventory, b.t.products, b.t.warehouses)


@query("x6_replenishment_sheet", q(f"""SELECT warehouse_name, product_id, product_name, current_stock, reorder_level, reorder_point, safety_stock, eoq, suggested_order_qty,
    {D('suggested_order_cost')} AS suggested_order_cost FROM repl WHERE below_rop""", o.REPL))
def _(b: Bed) -> DataFrame:
    return su.replenishment_sheet(b.repl)


@query("x7_category_year_cube", q("SELECT * FROM cubed", o.cube_sql("category", "year")))
def _(b: Bed) -> DataFrame:
    return su.revenue_cube(*b.sw, "category", "year")


@query("x7_warehouse_category_cube", q("SELECT * FROM cubed", o.cube_sql("warehouse", "category")))
def _(b: Bed) -> DataFrame:
    return su.revenue_cube(*b.sw, "warehouse", "category")


# ================================================================================================ sums kept by a refresh
def _over_sums(name: str) -> None:
    """The same query over clean files, where it reads sums by month instead of order lines."""
    @query(f"{name}_of_sums", SQL[name])
    def _(b: Bed) -> DataFrame:
        return QUERIES[name](b.refreshed())


for _name in ("k1_n1_headline", "k2_n3_monthly_sales", "k6_category_summary", "k7_n4_warehouse_summary", "n12_top_product_ids",
              "h9_warehouse_months", "m1_m4_sales_measures"):
    _over_sums(_name)


@query("k3v_turnover_of_sums", SQL["k3v_turnover_view"])
def _(b: Bed) -> DataFrame:
    r = b.refreshed()
    return kpis.stock_turnover_view(r.added("pairs"), *r.receipts[1:])


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries as (spark, folder) -> DataFrame."""
    def bind(build: Callable[[Bed], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plain(build(Bed(spark, sf_dir.rstrip("/"))))
    return {name: bind(build) for name, build in QUERIES.items()}
