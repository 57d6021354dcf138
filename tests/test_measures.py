"""Measures off the plain path: wrong grains and filters end in clear errors."""
import pytest
from builders import by

from shelfwise.operators import measures as ms


def test_stock_measures_have_no_dates(tables):
    with pytest.raises(ValueError, match="no value by month"):
        ms.measure(tables, "total_stock", ["month"])
    with pytest.raises(ValueError, match="needs a date column"):
        ms.measure(tables, "sales_ly", ["category"])
    with pytest.raises(ValueError, match="group by product_id"):
        ms.measure(tables, "movement_class", ["category"])


def test_class_under_a_category_filter_is_that_of_all_products(tables):
    every = {k: r.movement_class for k, r in by(ms.measure(tables, "movement_class", ["product_id"]), "product_id").items()}
    some = {k: r.movement_class for k, r in by(ms.measure(tables, "movement_class", ["product_id"], ms.Filters(categories=["Staples"])), "product_id").items()}
    assert some == {"C": every["C"]}


def test_rank_by_category_counts_product_names(tables):
    ranks = {k: r.revenue_rank for k, r in by(ms.measure(tables, "revenue_rank", ["category"]), "category").items()}
    # Alpha sold 72, Beta 24, Gamma 4: no name sold more than Snacks as a whole, two sold more than Staples
    assert ranks == {"Snacks": 1, "Staples": 3}
