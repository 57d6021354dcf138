import math
import random
import statistics

import pytest
from builders import by
from pyspark.sql import functions as F

from shelfwise.functions import ordering
from shelfwise.operators import kpis, served
from shelfwise.operators import summaries as su


def test_headline(tables):
    r = kpis.headline(tables.sales, tables.inventory).first()
    assert (float(r.total_sales), r.units_sold, r.total_stock, r.low_stock_items) == (100.0, 45, 117, 3)


def test_monthly_sales_and_growth(tables):
    m = kpis.monthly_sales(tables.sales).orderBy("month").collect()
    assert [float(r.revenue) for r in m] == [60.0, 40.0]
    assert m[0].mom_growth_pct is None and m[1].mom_growth_pct == -33.3


def test_turnover_per_pair(tables):
    k = by(kpis.stock_turnover(tables.sales, tables.inventory, tables.restocks, tables.products), "warehouse_id", "product_id")
    assert k["W1", "A"].stock_turnover == 1.5 and k["W1", "A"].days_of_inventory == 10
    assert k["W1", "C"].stock_turnover == 0.2 and k["W2", "C"].units_sold == 0
    assert k["W1", "A"].movement_class == "Fast"
    assert sorted(r.movement_class for r in k.values()) == ["Fast", "Fast", "Medium", "Medium", "Medium", "Slow"]


def test_turnover_per_product(tables):
    k = by(kpis.stock_turnover(tables.sales, tables.inventory, tables.restocks, tables.products, level="product"), "product_id")
    assert len(k) == 3 and k["A"].units_sold == 36 and k["A"].stock_turnover == round(36 / ((85 + 45) / 2), 2)


def test_turnover_without_receipts_uses_current_stock(tables):
    none = tables.restocks.filter("false")
    k = by(kpis.stock_turnover(tables.sales, tables.inventory, none, tables.products), "warehouse_id", "product_id")
    assert k["W1", "A"].stock_turnover == 6.0
    assert k["W1", "C"].stock_turnover is None and k["W1", "C"].movement_class == "n/a"


def test_alerts_order_and_severity(tables):
    a = kpis.reorder_alerts(tables.sales, tables.inventory, tables.products, tables.warehouses).collect()
    assert [(r.warehouse_id, r.product_id) for r in a] == [("W1", "C"), ("W1", "A"), ("W2", "B")]
    assert [r.severity for r in a] == ["Stockout", "Low", "Low"]
    assert [r.shortfall for r in a] == [10, 5, 8] and a[0].warehouse_name == "Delhi"


def test_category_summary(tables):
    c = by(kpis.category_summary(tables.sales, tables.products), "category")
    assert float(c["Snacks"].revenue) == 96.0 and float(c["Snacks"].gross_profit) == 44.0
    assert round(sum(r.revenue_share_pct for r in c.values())) == 100


def test_warehouse_summary(tables):
    w = by(kpis.warehouse_summary(tables.sales, tables.inventory, tables.warehouses), "warehouse_id")
    assert float(w["W1"].revenue) == 79.0 and w["W1"].low_stock_items == 2
    assert w["W2"].total_stock == 62 and w["W2"].skus == 3


def test_filtered_kpis_and_unknown_values(tables):
    r = served.kpis_of(tables, warehouse_id="W1").first()
    assert float(r.total_sales) == 79.0 and r.low_stock_items == 2
    assert served.kpis_of(tables, category="Staples").first().units_sold == 1
    for bad in ({"warehouse_id": "W9"}, {"category": "Toys"}):
        try:
            served.kpis_of(tables, **bad)
            raise AssertionError("unknown value accepted")
        except LookupError:
            pass


def test_alerts_read_counts_before_the_limit(tables):
    rows = served.alerts_of(tables, severity="Low", limit=1).collect()
    assert len(rows) == 1 and rows[0]["count"] == 2 and rows[0].product_id == "A"


def test_digest(tables):
    alerts = kpis.reorder_alerts(tables.sales, tables.inventory, tables.products, tables.warehouses)
    text = su.alert_digest(alerts).first().message
    assert text.splitlines()[0] == "Positions due: 3; Stockout 1; Critical 0; Low 2"
    assert text.index("Gamma") < text.index("Alpha") and "Delhi" in text and "Further" not in text
    assert su.alert_digest(alerts, lines=1).first().message.endswith("Further positions: 2")
    assert su.alert_digest(alerts.filter("false")).first().message == "No position is due."


@pytest.mark.parametrize("small", [10**6, 20])
def test_classes_and_median_by_selection(spark, monkeypatch, small):
    """Borders that run through equal values, rows without a turnover, and few rows; with and without brackets."""
    monkeypatch.setattr(ordering, "SMALL", small)
    rng = random.Random(4)
    for n in (0, 3, 400):
        rows = [(f"W{rng.randrange(4)}", f"P{i}", rng.choice([None, 0.0, 1.0, 1.0, 2.5, round(rng.random(), 2)])) for i in range(n)]
        df = spark.createDataFrame(rows, "warehouse_id string, product_id string, stock_turnover double")
        for nulls_first in (False, True):
            rated = sorted((-(math.inf if v is None else v), w, p) for w, p, v in rows if nulls_first or v is not None)
            size, extra = divmod(len(rated), 4)
            want = {(w, p): "Fast" if k < size + (extra > 0) else "Slow" if k >= len(rated) - size else "Medium" for k, (_, w, p) in enumerate(rated)}
            got = {(r.warehouse_id, r.product_id): r.movement_class for r in kpis.quartile_labels(df, ["warehouse_id", "product_id"], nulls_first).collect()}
            assert got == {(w, p): want.get((w, p), "n/a") for w, p, _ in rows}
        values = [v for _, _, v in rows if v is not None]
        assert ordering.median(df, F.col("stock_turnover")) == (statistics.median(values) if values else None)
