from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from builders import day, frame  # noqa: E402

from shelfwise.schemas import INVENTORY, PRODUCTS, RESTOCKS, SALES, WAREHOUSES, Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(
        frame(spark, WAREHOUSES, [("W1", "Delhi", "N"), ("W2", "Mumbai", "W")]),
        frame(spark, PRODUCTS, [("A", "Alpha", "Snacks", 1.0, 2.0, 5), ("B", "Beta", "Snacks", 2.0, 3.0, 5), ("C", "Gamma", "Staples", 3.0, 4.0, 5)]),
        frame(spark, INVENTORY, [("W1", "A", 5, 10), ("W1", "B", 50, 10), ("W1", "C", 0, 10), ("W2", "A", 40, 10), ("W2", "B", 2, 10), ("W2", "C", 20, 10)]),
        frame(spark, RESTOCKS, [(day("2025-01-01"), w, p, q) for w, p, q in
                                (("W1", "A", 35), ("W1", "B", 55), ("W1", "C", 10), ("W2", "A", 50), ("W2", "B", 20), ("W2", "C", 25))]),
        frame(spark, SALES, [
            ("1", day("2025-01-01"), "W1", "A", 10, 2.0, 20.0), ("2", day("2025-01-15"), "W1", "A", 20, 2.0, 40.0),
            ("3", day("2025-02-01"), "W1", "B", 5, 3.0, 15.0), ("4", day("2025-02-10"), "W1", "C", 1, 4.0, 4.0),
            ("5", day("2025-02-10"), "W2", "A", 6, 2.0, 12.0), ("6", day("2025-02-11"), "W2", "B", 3, 3.0, 9.0)]))
