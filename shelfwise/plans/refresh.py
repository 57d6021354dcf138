"""The daily refresh: raw CSV exports to clean, checked tables. Nothing is written when the gate is shut.

The tables and the report go to a new version folder, which is put in force as a whole at the end: a refresh that fails or is
killed anywhere leaves the version before readable, and a reader sees the tables of one refresh only.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage, together
from shelfwise.operators import cleaning as c
from shelfwise.operators.quality import assert_valid
from shelfwise.schemas import Tables
from shelfwise.sources.files import new_version, publish_version, read_raw, write_report, write_tables


def clean_staged(raw: Tables) -> tuple[Tables, DataFrame]:
    """Clean every table once; gate, report and output all read the staged results."""
    warehouses, products = together(lambda: stage(c.clean_warehouses(raw.warehouses), "warehouses"),
                                    lambda: stage(c.clean_products(raw.products), "products"))
    typed = c.type_sales(raw.sales)
    judged, inventory, restocks = together(
        lambda: stage(c.judge_sales(c.dedupe_orders(typed), products, warehouses), "judged-sales"),
        lambda: stage(c.clean_inventory(raw.inventory, products, warehouses), "inventory"),
        lambda: stage(c.clean_restocks(raw.restocks, products, warehouses), "restocks"))
    tables = Tables(warehouses, products, inventory, restocks, c.accepted_sales(judged))
    return tables, c.sales_report(typed, judged)


def row_counts(tables: Tables) -> dict[str, int]:
    names = [name for name, _ in tables.items()]
    return dict(zip(names, together(*[df.count for _, df in tables.items()])))


def refresh(spark: SparkSession, raw_folder: str, clean_folder: str, csv: bool = True, strict: bool = True) -> DataFrame:
    """Read, clean, check, write. Returns the one-row report (counters and row counts), which is also written as JSON.

    A second run over the same exports yields a version with the same tables.
    """
    tables, report = clean_staged(read_raw(spark, raw_folder))
    assert_valid(tables, strict)
    version = new_version()
    target = f"{clean_folder}/{version}"
    write_tables(tables, target, csv)
    full = report.withColumns({f"rows_{name}": F.lit(n) for name, n in row_counts(tables).items()})
    write_report(full, f"{target}/cleaning_report.json")
    publish_version(spark, clean_folder, version)
    return spark.read.schema(full.schema).json(f"{target}/cleaning_report.json")
