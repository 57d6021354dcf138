"""Sums by month kept by a refresh: same results as order lines, read no order lines, rebuilt for changed months only."""
import datetime as dt

import pytest
from builders import frame
from pyspark.sql import functions as F

from shelfwise.functions import staging, versions
from shelfwise.operators import kpis, measures, rollups, served
from shelfwise.schemas import SALES
from shelfwise.sources import files, sums


def sales_rows():
    start = dt.date(2024, 1, 1)
    return [(f"{i}{p}", start + dt.timedelta(days=i), "W1" if i % 3 else "W2", p, 1 + (i * k) % 4, 2.5, 2.5 * (1 + (i * k) % 4))
            for i in range(0, 100, 2) for k, p in ((5, "A"), (7, "B"))]


@pytest.fixture(scope="module")
def clean(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sums") / "clean")
    t = tables.with_(sales=frame(spark, SALES, sales_rows()))
    files.write_clean(t, folder, csv=False)
    return t, folder


def same(a, b):
    assert a.columns == b.columns
    numbers = lambda df: sorted([[float(v) if hasattr(v, "as_tuple") else v for v in r] for r in df.collect()], key=str)
    assert numbers(a) == numbers(b)


def added(spark, folder):
    return {grain: files.load_sums(spark, folder, grain) for grain in rollups.GRAINS}


def test_same_results_as_order_lines(spark, clean):
    t, folder = clean
    s = added(spark, folder)
    for grain in ("places", "products", "pairs"):
        same(kpis.headline(t.sales, t.inventory), kpis.headline(s[grain], t.inventory))
        same(kpis.monthly_sales(t.sales), kpis.monthly_sales(s[grain]))
    same(kpis.warehouse_summary(t.sales, t.inventory, t.warehouses), kpis.warehouse_summary(s["places"], t.inventory, t.warehouses))
    same(kpis.category_summary(t.sales, t.products), kpis.category_summary(s["products"], t.products))
    same(kpis.top_products(t.sales, t.products), kpis.top_products(s["products"], t.products))
    same(kpis.sold_per_pair(t.sales), kpis.sold_per_pair(s["pairs"]))
    same(kpis.stock_turnover(t.sales, t.inventory, t.restocks, t.products), kpis.stock_turnover(s["pairs"], t.inventory, t.restocks, t.products))
    with_sums = t.with_(sales=s["pairs"])
    same(measures.sales_by(t, ["category", "month"]), measures.sales_by(with_sums, ["category", "month"]))
    same(served.kpis_of(t, "W1", "Snacks"), served.kpis_of(with_sums, "W1", "Snacks"))


def test_no_order_lines_are_read(spark, clean):
    t, folder = clean
    s = added(spark, folder)
    for df in (s["places"], kpis.monthly_sales(s["places"]), kpis.top_product_ids(s["products"]), kpis.sold_per_pair(s["pairs"])):
        opened = df.inputFiles()
        assert opened and not any("sales.parquet" in path for path in opened)
    assert s["places"].agg(F.sum("lines")).first()[0] == t.sales.count()
    assert s["places"].count() == 8 and s["products"].count() == 8


def test_only_changed_months_are_summed_again(spark, clean, monkeypatch, tmp_path):
    t, _ = clean
    folder = str(tmp_path / "clean")
    files.write_clean(t, folder, csv=False)
    first = versions.current(spark, folder)[1]["sums"]
    summed = []
    monkeypatch.setattr(sums, "month_sums", lambda sales, grain="pairs": summed.append(
        sorted(r[0] for r in sales.select("order_month").distinct().collect())) or rollups.month_sums(sales, grain))

    files.write_clean(t.with_(sales=t.sales.orderBy(F.rand(3)).withColumn("order_id", F.concat("order_id", F.lit("x")))), folder, csv=False)
    assert summed == [] and versions.current(spark, folder)[1]["sums"] == first     # other order and ids, same sums

    march = F.when((F.month("order_date") == 3) & (F.col("product_id") == "A"), 2).otherwise(1)
    changed = t.with_(sales=t.sales.withColumns({"quantity": F.col("quantity") * march, "revenue": (F.col("revenue") * march).cast("decimal(14,2)")}))
    files.write_clean(changed, folder, csv=False)
    second = versions.current(spark, folder)[1]["sums"]
    assert summed == [["2024-03"]]
    assert [e["month"] for e in first if e not in second] == ["2024-03"]
    same(kpis.monthly_sales(changed.sales), kpis.monthly_sales(files.load_sums(spark, folder, "places")))

    # a month that goes is no longer listed; folders are kept as long as a kept version names them
    without = changed.with_(sales=changed.sales.filter("month(order_date) <> 1"))
    files.write_clean(without, folder, csv=False)
    files.write_clean(without, folder, csv=False)
    third = versions.current(spark, folder)[1]["sums"]
    assert [e["month"] for e in third] == ["2024-02", "2024-03", "2024-04"]
    assert all(staging.exists(spark, f"{folder}/{e['folder']}/pairs") for e in third)
    same(kpis.sold_per_pair(without.sales), kpis.sold_per_pair(files.load_sums(spark, folder, "pairs")))

    # every month changed: the folders of the first sums expire with the last version that named them
    doubled = without.with_(sales=without.sales.withColumn("quantity", F.col("quantity") + 1))
    for _ in range(2):
        files.write_clean(doubled, folder, csv=False)
    assert not any(staging.exists(spark, f"{folder}/{e['folder']}") for e in third)
    same(kpis.monthly_totals(doubled.sales), kpis.monthly_totals(files.load_sums(spark, folder, "products")))


def test_folders_are_united_before_they_are_many(spark, clean, monkeypatch, tmp_path):
    t, _ = clean
    monkeypatch.setattr(sums, "MOST_FOLDERS", 2)
    folder, now = str(tmp_path / "clean"), t
    for month in (0, 1, 2, 3):
        more = F.when(F.month("order_date") == month, 1).otherwise(0)
        now = now.with_(sales=now.sales.withColumn("quantity", F.col("quantity") + more))
        files.write_clean(now, folder, csv=False)
        state = versions.current(spark, folder)[1]["sums"]
        assert len({e["folder"] for e in state}) == (1, 2, 1, 2)[month]
        for grain in rollups.GRAINS:
            same(rollups.month_sums(now.sales, grain), files.load_sums(spark, folder, grain))


def test_lines_that_swap_values_change_the_print(spark, clean):
    t, _ = clean
    prints = lambda s: {r["order_month"]: r["print"] for r in rollups.month_prints(s).collect()}
    swapped = t.sales.withColumn("warehouse_id", F.when(F.col("warehouse_id") == "W1", "W2").otherwise("W1"))
    before, after = prints(t.sales), prints(swapped)
    assert before.keys() == after.keys() and all(before[m] != after[m] for m in before)
    assert prints(t.sales.repartition(7)) == before
    twice = prints(t.sales.unionByName(t.sales))
    assert all(twice[m] != before[m] for m in before)


def test_empty_sales_and_lines_without_values(spark, clean, tmp_path):
    t, _ = clean
    empty = str(tmp_path / "empty")
    files.write_clean(t.with_(sales=t.sales.limit(0)), empty, csv=False)
    assert files.load_sums(spark, empty, "pairs").count() == 0 and versions.current(spark, empty)[1]["sums"] == []
    same(kpis.headline(t.sales.limit(0), t.inventory), kpis.headline(files.load_sums(spark, empty, "places"), t.inventory))

    odd = frame(spark, SALES, [("1", None, "W1", "A", 2, 1.0, 2.0), ("2", dt.date(2024, 5, 1), None, "A", None, 1.0, None),
                               ("3", dt.date(2024, 5, 2), None, None, 4, 1.0, 4.0)])
    folder = str(tmp_path / "odd")
    files.write_clean(t.with_(sales=odd), folder, csv=False)
    for grain in rollups.GRAINS:
        got = files.load_sums(spark, folder, grain)
        same(rollups.month_sums(odd, grain), got)
        assert got.agg(F.sum("lines")).first()[0] == 3


def test_versions_without_sums_are_summed_from_lines(spark, clean, tmp_path):
    t, _ = clean
    folder = str(tmp_path / "old")
    files.write_tables(t, folder, csv=False)
    same(rollups.month_sums(t.sales, "products"), files.load_sums(spark, folder, "products"))
