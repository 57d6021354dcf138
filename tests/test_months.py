"""Windows of days over clean tables open the months they touch, also where the days come from the data."""
import datetime as dt

import pytest
from builders import frame
from pyspark.sql import functions as F

from shelfwise.functions import months
from shelfwise.operators import demand, forecast, health, kpis, measures
from shelfwise.schemas import SALES
from shelfwise.sources import files

START, DAYS = dt.date(2023, 1, 1), 26 * 30


@pytest.fixture(scope="module")
def long_tables(spark, tables, tmp_path_factory):
    """26 months of two sales a day, in one file a month."""
    rows = [(f"{i}{p}", START + dt.timedelta(days=i), "W1" if i % 3 else "W2", p, 1 + (i * k) % 4, 2.0, 2.0 * (1 + (i * k) % 4))
            for i in range(DAYS) for k, p in ((5, "A"), (7, "B"))]
    folder = str(tmp_path_factory.mktemp("long") / "clean")
    plain = tables.with_(sales=frame(spark, SALES, rows).coalesce(1))
    files.write_clean(plain, folder, csv=False)
    return plain, files.load_clean(spark, folder)


def scans(node):
    """File scans of a finished plan, subqueries left out."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scans(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return scans(node.plan())
    if name == "FileSourceScanExec":
        return [node]
    children = node.children()
    return [s for i in range(children.size()) for s in scans(children.apply(i))]


def files_opened(df, column):
    """Files that scans of this column have opened, the most of any scan."""
    df.collect()
    found = scans(df._jdf.queryExecution().executedPlan())
    opened = [s.metrics().apply("numFiles").value() for s in found if column in s.schema().fieldNames() and "order_date" in s.schema().fieldNames()]
    assert opened
    return max(opened)


def test_months_opened(long_tables):
    _, t = long_tables
    assert files_opened(kpis.warehouse_month(t.sales, "W1", 2024, 2), "revenue") == 1
    assert files_opened(kpis.reorder_alerts(t.sales, t.inventory, t.products, t.warehouses), "quantity") <= 4
    assert files_opened(kpis.reorder_alerts_view(t.sales, t.inventory, t.products, t.warehouses), "quantity") <= 4
    assert files_opened(demand.recent_history(t.sales), "quantity") <= 5
    active = health.dead_stock(t.sales, t.inventory)
    assert files_opened(active, "warehouse_id") <= 4
    chosen = measures.filter_tables(t, measures.Filters(first_day="2023-03-05", last_day="2023-04-01"))
    assert files_opened(chosen.sales, "revenue") == 2


def test_forecast_reads_its_windows_once(long_tables):
    _, t = long_tables
    for holdout, most in ((0, 3 + 4), (30, 4 + 4)):
        sums = forecast._window_sums(t.sales, 30, holdout)
        assert files_opened(sums, "quantity") <= most
        found = scans(sums._jdf.queryExecution().executedPlan())
        assert sum("quantity" in s.schema().fieldNames() for s in found) == 1
        assert "CASE" not in sums._jdf.queryExecution().optimizedPlan().toString().upper()


def test_same_results_with_and_without_months(long_tables):
    plain, t = long_tables
    assert months.MONTH in t.sales.columns and months.MONTH not in plain.sales.columns
    for build in (lambda x: kpis.reorder_alerts(x.sales, x.inventory, x.products, x.warehouses),
                  lambda x: forecast.forecast(x.sales, 90, x.products), lambda x: forecast.backtest(x.sales, 90, x.products),
                  lambda x: demand.recent_history(x.sales), lambda x: demand.demand_stats(x.sales),
                  lambda x: x.sales.select(months.first_day(x.sales).alias("a"), months.last_day(x.sales).alias("b")).distinct()):
        assert sorted(map(str, build(plain).collect())) == sorted(map(str, build(t).collect()))


def test_edges_of_a_window(long_tables):
    _, t = long_tables
    days = lambda s: s.agg(F.min("order_date"), F.max("order_date"), F.count_distinct("order_date")).first()
    last = START + dt.timedelta(days=DAYS - 1)
    assert tuple(days(months.recent(t.sales, 40))) == (last - dt.timedelta(days=39), last, 40)
    one = F.lit("2023-02-28").cast("date")
    assert tuple(days(months.within(t.sales, one, one))) == (dt.date(2023, 2, 28), dt.date(2023, 2, 28), 1)
    empty = t.sales.filter("product_id = 'none'")
    assert months.recent(empty, 5).count() == 0
