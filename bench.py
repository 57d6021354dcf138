"""Times the headline queries and prints one JSON line.

The canonical tables are derived from the test tables and written once (`load`, not part of the total), as a refresh leaves
them. Every query then runs once to warm up and RUNS times; the median is reported. A run builds the plan and computes the
whole result (noop sink).
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from shelfwise.functions.staging import new_path
from shelfwise.operators.quality import problems
from shelfwise.plans import catalog, refresh, testbed
from shelfwise.sources import files

RUNS = 3
HEADLINE = [
    "k1_n1_headline", "k2_n3_monthly_sales", "n12_top_product_ids", "k7_n4_warehouse_summary", "k5v_n6_alerts_view",
    "k4_movement_classes", "n10_warehouse_month", "n11_product_days", "k3_stock_turnover", "k6_category_summary",
    "a2_abc_xyz", "a4_forecast", "a5_backtest", "a6_demand_stats", "a7_a9_replenishment", "a10_transfer_suggestions",
    "a11_inventory_health", "a12_delay_curve", "q1_q23_quality_report",
]


def session(cpus: str) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run, runs: int = RUNS) -> float:
    run()
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or [*HEADLINE, "clean_and_validate"]
    results = {}
    start = time.perf_counter()
    clean = new_path(spark, "bench-clean")
    files.write_clean(testbed.canonical(spark, sf_dir), clean, csv=False)
    load = round(time.perf_counter() - start, 3)
    tables, sums = files.load_clean(spark, clean), catalog.load_all_sums(spark, clean)

    def compute(name: str) -> None:
        bed = catalog.Bed(spark, sf_dir, tables, sums)
        catalog.QUERIES[name](bed).write.format("noop").mode("overwrite").save()

    for name in wanted:
        if name in catalog.QUERIES:
            results[name] = timed(lambda: compute(name))
    if "clean_and_validate" in wanted:
        folder = new_path(spark, "bench-raw")
        for name, df in testbed.raw_tables(spark, sf_dir).items():
            files.write_csv(df, f"{folder}/raw_{name}.csv")
        results["clean_and_validate"] = timed(lambda: problems(refresh.clean_staged(files.read_raw(spark, folder))[0]), 1)
    total = round(sum(results.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": results, "load": load,
                      "sf": float(os.path.basename(sf_dir).removeprefix("sf"))}))
    spark.stop()


if __name__ == "__main__":
    main()
