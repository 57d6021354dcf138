"""Steps whose cost must grow no faster than their input: what is shuffled, sorted and read how often."""
import datetime as dt

from builders import by, day, daily_sales, frame
from pyspark.sql import functions as F

from shelfwise.functions.firsts import POSITION
from shelfwise.functions.ordering import number_rows
from shelfwise.operators import demand
from shelfwise.operators import importing as im
from shelfwise.schemas import INVENTORY, PRODUCTS, SALES


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_daily_matrix_is_not_shuffled(spark):
    m = demand.daily_matrix(daily_sales(spark, {"A": lambda i: i % 3, "B": lambda i: i % 2}, 20))
    assert "Join" not in plan_of(m.groupBy("product_id").agg(F.sum("units")))


def test_the_daily_matrix_fills_around_gaps(spark):
    s = frame(spark, SALES, [
        ("1", day("2025-01-02"), "W1", "A", 2, 1.0, 2.0), ("2", day("2025-01-05"), "W1", "A", 3, 1.0, 3.0), ("3", day("2025-01-05"), "W2", "A", 4, 1.0, 4.0),
        ("4", day("2025-01-01"), "W1", "B", 1, 1.0, 1.0), ("5", day("2025-01-06"), "W1", "B", None, 1.0, 1.0),
        ("6", None, "W1", "C", 9, 1.0, 9.0), ("7", day("2025-01-03"), "W1", None, 8, 1.0, 8.0)])
    rows = by(demand.daily_matrix(s), "product_id", "day")
    days = [day("2025-01-01") + dt.timedelta(days=i) for i in range(6)]
    units = {p: [rows[(p, d)]["units"] for d in days] for p in ("A", "B", "C", None)}
    assert units == {"A": [0, 2, 0, 0, 7, 0], "B": [1, 0, 0, 0, 0, 0], "C": [0] * 6, None: [0] * 6} and len(rows) == 24


def export(spark):
    rows = [("03/01/2025", f" P{i % 3} ", str(i % 5), "S1", "2.50", None) for i in range(30)]
    return im.Export.of(spark.createDataFrame(rows, "`Bill Date` string, Item string, Qty string, Store string, Rate string, Invoice string"), "sales")


def test_no_filter_repeats_the_parsing_of_values(spark):
    e = export(spark)
    kept = im.label_sales(e, im.choose_date_rule(e.rows, e.text("order_date"))).filter("reason IS NULL")
    filters = [line for line in plan_of(kept).splitlines() if line.strip(" +-:").startswith("Filter")]
    assert filters and not any("regexp" in line or "RLIKE" in line or "timestamp" in line for line in filters)
    assert kept.count() == 24


def test_rows_are_shuffled_once_to_be_numbered(spark):
    df = spark.range(0, 500, 1, 5).select(((F.col("id") * 37) % 101).alias("v"), "id")
    numbered = number_rows(df, [F.col("v").asc(), F.col("id").desc()], "n")
    assert numbered._jdf.queryExecution().sparkPlan().toString().count("Window") == plan_of(numbered).count("Window") == 2      # both over the offsets
    got = sorted(numbered.collect(), key=lambda r: r["n"])
    assert [(r["v"], r["id"]) for r in got] == sorted(((i * 37 % 101, i) for i in range(500)), key=lambda r: (r[0], -r[1]))
    assert [r["n"] for r in got] == [*range(1, 501)] and {r["n_total"] for r in got} == {500}


def test_orders_are_read_once_for_their_products(spark, tmp_path):
    e = export(spark)
    orders = im.unique_orders(im.number_orders(im.label_sales(e, im.choose_date_rule(e.rows, e.text("order_date")))))
    orders.write.parquet(str(tmp_path / "orders-read"))
    sold = im.sold_products(spark.read.parquet(str(tmp_path / "orders-read")), None)
    assert not [f for f in sold.inputFiles() if "orders-read" in f]
    assert {(r["product_id"], float(r["unit_price"])) for r in sold.collect()} == {("P0", 2.5), ("P1", 2.5), ("P2", 2.5)}


def test_numbered_orders_carry_a_short_position(spark):
    e = export(spark)
    numbered = im.number_orders(im.label_sales(e, im.choose_date_rule(e.rows, e.text("order_date"))))
    assert numbered.select(f"{POSITION}.*").columns == ["row"] and numbered.filter(F.col(f"{POSITION}.row").isNull()).isEmpty()


def test_unsold_products_need_no_order_of_prices(spark):
    sold = frame(spark, PRODUCTS, [("A", "A", "x", 1.0, 2.0, 1), ("B", "B", "x", 1.0, 5.0, 1)])
    unsold = im.unsold_products(frame(spark, INVENTORY, [("W", "A", 1, 1), ("W", "C", 1, 1)]), sold)
    assert not [f for f in unsold.inputFiles() if "quantiles" in f]
    assert [(r["product_id"], float(r["unit_price"])) for r in unsold.collect()] == [("C", 3.5)]
