import pytest
from builders import day
from pyspark.sql import functions as F

from shelfwise.functions.columns import format_date, parse_date, title_case, to_number
from shelfwise.operators import cleaning, quality
from shelfwise.operators.quality import DataQualityError
from shelfwise.plans.refresh import refresh
from shelfwise.schemas import Tables
from shelfwise.sources import files


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers(spark):
    assert column(spark, ["$12.50", "1,200", "7", "abc", None], to_number) == [12.5, 1200, 7, None, None]
    # kept as they are: no blank after the point of "Rs.", brackets, exponents
    assert column(spark, ["Rs. 1,200.50", "Rs.500", "(12)", "1e5", "-3"], to_number) == [1200.5, 0.5, 12, 1, -3]


def test_dates(spark):
    got = column(spark, ["2024-03-05", "05/03/2024", "5/3/2024", "05-Mar-2024", "nonsense", "30/02/2024"], parse_date)
    assert got == [day("2024-03-05")] * 4 + [None, None]
    assert column(spark, ["31/12/75", "31/12/68"], lambda c: format_date(c, "d/M/yy")) == [day("1975-12-31"), day("2068-12-31")]


def test_title_case(spark):
    words = ["hand-blender", " SNACKS", "o'neil's a1b", "x--y z"]
    assert column(spark, words, title_case) == [w.title() for w in words]


def raw_products(spark, days="3"):
    return spark.createDataFrame([("A", " X ", " snacks ", "1.0", "$2.00", days), ("A", " Y ", "SNACKS", "1.0", "$2.00", "4")],
                                 "product_id string, product_name string, category string, unit_cost string, unit_price string, lead_time_days string")


def test_products(spark):
    rows = cleaning.clean_products(raw_products(spark)).collect()
    assert len(rows) == 1 and (rows[0].product_name, rows[0].category, float(rows[0].unit_price), rows[0].lead_time_days) == ("X", "Snacks", 2.0, 3)
    with pytest.raises(Exception, match="lead time is not a number"):
        cleaning.clean_products(raw_products(spark, "soon")).collect()


SALES_TEXT = "order_id string, order_date string, warehouse_id string, product_id string, quantity string, unit_price string"


def raw_sales(spark, quantity=("1", "2", "3", None, "4", "1", "1")):
    ids, price = ("1", "2", "3", "3", "4", "5", "6"), ("$2.00", None, "$2.00", "$2.00", "$2.00", "$2.00", "$2.00")
    product, place = ("A",) * 5 + ("Z", "A"), ("W1",) * 6 + (None,)
    return spark.createDataFrame([(ids[i], "2025-01-01", place[i], product[i], quantity[i], price[i]) for i in range(7)], SALES_TEXT)


def test_sales_rules(spark, tables):
    sales, report = cleaning.clean_sales(raw_sales(spark), tables.products, tables.warehouses)
    r = report.first()
    assert (r.rows_in, r.duplicates_removed, r.prices_filled_from_master, r.invalid_rows_dropped, r.rows_out) == (7, 1, 1, 2, 4)
    rows = {x.order_id: x for x in sales.collect()}
    assert float(rows["2"].unit_price) == 2.0 and rows["3"].quantity == 3
    assert all(float(x.revenue) == x.quantity * float(x.unit_price) for x in rows.values())
    less, _ = cleaning.clean_sales(raw_sales(spark, ("0", None, "1", "1", "1", "1", "1")), tables.products, tables.warehouses)
    assert {x.order_id for x in less.collect()} == {"3", "4"}


def test_gate(spark, tables):
    assert quality.problems(tables) == []
    orphan = tables.sales.withColumns({"product_id": F.expr("CASE order_id WHEN '1' THEN 'ZZZ' ELSE product_id END"),
                                       "quantity": F.expr("CASE order_id WHEN '2' THEN -1 ELSE quantity END"),
                                       "warehouse_id": F.expr("CASE order_id WHEN '3' THEN 'W9' ELSE warehouse_id END")})
    found = " ".join(quality.problems(tables.with_(sales=orphan)))
    assert "sales products known: 1" in found and "sales warehouses known: 1" in found and "sales quantity positive: 1" in found
    with pytest.raises(DataQualityError):
        quality.assert_valid(tables.with_(sales=orphan))
    twice = tables.with_(inventory=tables.inventory.unionByName(tables.inventory.limit(1)),
                         sales=tables.sales.withColumn("order_id", F.expr("CASE order_id WHEN '2' THEN '1' ELSE order_id END")))
    found = " ".join(quality.problems(twice))
    assert "inventory pair unique: 1" in found and "sales order id unique: 1" in found
    negative = tables.with_(inventory=tables.inventory.withColumn("current_stock", F.col("current_stock") - 3))
    assert any("stock not negative" in p for p in quality.problems(negative))
    lean = tables.with_(inventory=tables.inventory.filter("false"), restocks=tables.restocks.filter("false"))
    assert quality.problems(lean, strict=False) == [] and len(quality.problems(lean)) == 2


def write_raw(spark, tables, folder):
    sold = tables.sales.drop("revenue").withColumns({"order_date": F.date_format("order_date", "dd/MM/yyyy"), "unit_price": F.concat(F.lit("Rs. "), "unit_price")})
    raw = Tables(tables.warehouses, tables.products, tables.inventory, tables.restocks, sold)
    for name, df in raw.items():
        files.write_csv(df, f"{folder}/raw_{name}.csv")


def test_refresh_is_repeatable_and_complete(spark, tables, tmp_path):
    raw, clean = str(tmp_path / "raw"), str(tmp_path / "clean")
    with pytest.raises(FileNotFoundError, match="raw_sales.csv"):
        files.read_raw(spark, raw)
    write_raw(spark, tables, raw)
    for _ in range(2):
        r = refresh(spark, raw, clean).first()
        assert (r.rows_in, r.rows_out, r.rows_inventory, r.rows_restocks) == (6, 6, 6, 6)
    loaded, label = files.load_data(spark, [str(tmp_path / "none"), clean])
    assert label == clean
    for (name, want), (_, got) in zip(tables.items(), loaded.items()):
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())), name
    assert files.read_table(spark, clean, "sales").columns == tables.sales.columns and loaded.sales.columns[:-1] == tables.sales.columns
    csv_only = str(tmp_path / "csv")
    for name, df in tables.items():
        files.write_csv(df, f"{csv_only}/{name}.csv")
    assert sorted(map(tuple, files.load_clean(spark, csv_only).sales.collect())) == sorted(map(tuple, tables.sales.collect()))
    assert files.read_sales_between(spark, clean, "2025-02-01", "2025-02-10").count() == 3
    with pytest.raises(FileNotFoundError):
        files.load_data(spark, [str(tmp_path / "none")])


def test_gate_stops_the_refresh_before_writing(spark, tables, tmp_path):
    raw, clean = str(tmp_path / "raw"), tmp_path / "clean"
    write_raw(spark, tables.with_(products=tables.products.withColumn("unit_cost", F.lit(99))), raw)
    with pytest.raises(DataQualityError, match="price above cost"):
        refresh(spark, raw, str(clean))
    assert not clean.exists()


def test_missing_texts_in_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n"1,5",NA\n,"say ""hi"""\nn/a, x \n')
    rows = files.read_text_csv(spark, str(path)).orderBy("_position").collect()
    assert [(r.a, r.b) for r in rows] == [("1,5", None), (None, 'say "hi"'), (None, " x ")]


def test_json_records(spark):
    df = spark.createDataFrame([(1.5, day("2025-01-02")), (float("nan"), None), (float("inf"), day("2025-01-03"))], "x double, d date")
    assert sorted(r.record for r in files.json_records(df).collect()) == sorted([
        '{"x":1.5,"d":"2025-01-02T00:00:00"}', '{"x":null,"d":null}', '{"x":null,"d":"2025-01-03T00:00:00"}'])


def test_cells_that_no_column_holds(spark, tables):
    rows = [("1", "2025-01-01", "W1", "A", "99999999999", "$2.00"), ("2", "2025-01-01", "W1", "A", "3", "999999999.5"),
            ("3", "2025-01-01", "W1", "A", "2000000000", "99999999"), ("4", "2025-01-01", "W1", "A", "1", "$2.00")]
    sales, report = cleaning.clean_sales(spark.createDataFrame(rows, SALES_TEXT), tables.products, tables.warehouses)
    r = report.first()
    # too many units and too much revenue make a row invalid; a price too large counts as missing
    assert (r.rows_in, r.prices_filled_from_master, r.invalid_rows_dropped, r.rows_out) == (4, 1, 2, 2)
    assert sorted((x.order_id, x.quantity, float(x.revenue)) for x in sales.collect()) == [("2", 3, 6.0), ("4", 1, 2.0)]
    stock = spark.createDataFrame([("W1", "A", "99999999999", "5")], "warehouse_id string, product_id string, current_stock string, reorder_level string")
    assert cleaning.clean_inventory(stock, tables.products, tables.warehouses).isEmpty()
    received = spark.createDataFrame([("2025-01-01", "W1", "A", "99999999999"), ("2025-01-01", "W1", "A", "7")],
                                     "restock_date string, warehouse_id string, product_id string, quantity string")
    assert [r.quantity for r in cleaning.clean_restocks(received, tables.products, tables.warehouses).collect()] == [7]
