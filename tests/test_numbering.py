"""Order ids by file position and lines by day, without a range sort."""
from pyspark.sql import functions as F

from shelfwise.functions.firsts import POSITION
from shelfwise.functions.ordering import number_in_groups, number_rows
from shelfwise.operators import importing as im
from shelfwise.sources import files


def labelled(spark, folder, rows):
    """Label an export that was written to three files."""
    lines = spark.createDataFrame(rows, "n int, invoice string, date string, sku string, qty string, store string").repartitionByRange(3, "n")
    files.write_csv(lines.sortWithinPartitions("n").drop("n"), folder)
    e = files.read_text_csv(spark, folder)
    export = im.Export.of(e, "sales")
    return im.label_sales(export, im.choose_date_rule(e, export.text("order_date")))


def rows(n, has_id):
    return [(i, f"R{i}" if has_id(i) else None, f"2024-03-{1 + i % 28:02d}", f"S{i % 7}", "0" if i % 5 == 4 else "2", "W") for i in range(n)]


def test_positions_in_files_are_those_of_a_sort(spark, tmp_path):
    data = rows(200, lambda i: i % 3)
    found = im.number_orders(labelled(spark, str(tmp_path / "export"), data))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    kept = [r for r in data if r[4] != "0"]
    want = [r[1] or f"L{place:08d}" for place, r in enumerate(kept, 1)]
    assert [r["order_id"] for r in found.orderBy(POSITION).collect()] == want


def test_nothing_is_numbered_where_every_row_has_an_id(spark, tmp_path):
    found = im.number_orders(labelled(spark, str(tmp_path / "export"), rows(40, lambda i: True)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and found.count() == 32


def test_groups_with_nulls_hot_groups_and_no_rows(spark):
    df = spark.range(500).select(F.when(F.col("id") % 10 < 7, F.lit(3)).when(F.col("id") % 10 == 9, F.lit(None)).otherwise(F.col("id") % 13).alias("g"), "id")
    a = {r["id"]: r["n"] for r in number_in_groups(df, [F.col("g")], [F.col("id").asc()], "n").collect()}
    b = {r["id"]: r["n"] for r in number_rows(df, [F.col("g").asc(), F.col("id").asc()], "n").collect()}
    assert a == b and sorted(a.values()) == list(range(1, 501))
    assert number_in_groups(df.limit(0), [F.col("g")], [F.col("id")], "n").count() == 0
