"""Sums of sales by month beside the clean tables: only months whose order lines changed are summed again.

The state of a version lists per month the print of its order lines and the folder that holds its sums. A refresh compares prints
with the state in force, reads the order lines of the months that differ, and writes their sums to a folder of its own. Months of
older folders that are no longer listed are filtered out by readers. What a state lists is bounded by the calendar.
"""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.months import MONTH
from shelfwise.functions.staging import CODEC, together
from shelfwise.operators.rollups import GRAINS, coarser, month_prints, month_sums, sums_schema

#: Folders a reader unites; a refresh that would need more copies the older sums into its own folder (sums, not order lines).
MOST_FOLDERS = 8


def _of_months(months: list[str | None]) -> Column:
    named = F.coalesce(F.col(MONTH).isin([m for m in months if m is not None]), F.lit(False))
    return named | F.col(MONTH).isNull() if None in months else named


def write_sums(spark: SparkSession, folder: str, sales: DataFrame, before: list[dict]) -> list[dict]:
    """Sum the months of `sales` that `before` has not, or has with other order lines. Returns the state of all months."""
    known = {(entry["month"], entry["print"]): entry for entry in before}
    prints = sorted(((row[MONTH], row["print"]) for row in month_prints(sales).collect()), key=lambda p: p[0] or "")     # a row per month
    kept = [known[p] for p in prints if p in known]
    changed = [month for month, mark in prints if (month, mark) not in known]
    if not changed:
        return kept
    target = f"sums-{uuid.uuid4().hex}"
    pairs = month_sums(sales.filter(_of_months(changed)))
    if len({entry["folder"] for entry in kept}) >= MOST_FOLDERS:
        pairs, kept = pairs.unionByName(read_sums(spark, folder, kept, "pairs")), []
    _write(pairs, f"{folder}/{target}", "pairs")
    written = spark.read.schema(sums_schema("pairs")).parquet(f"{folder}/{target}/pairs")
    together(*[lambda g=g: _write(coarser(written, g), f"{folder}/{target}", g) for g in GRAINS if g != "pairs"])
    held = {entry["month"]: entry for entry in kept}
    return [held.get(month, {"month": month, "print": mark, "folder": target}) for month, mark in prints]


def _write(sums: DataFrame, target: str, grain: str) -> None:
    # sums come out of a grouping, whose even partitions become the files: they are not shuffled a second time
    ordered = sums.sortWithinPartitions(MONTH, *reversed(GRAINS[grain]))
    ordered.write.option("compression", CODEC).parquet(f"{target}/{grain}")


def read_sums(spark: SparkSession, folder: str, state: list[dict], grain: str) -> DataFrame:
    """The sums that a state lists, without reading any order line."""
    schema = sums_schema(grain)
    months: dict[str, list] = {}
    for entry in state:
        months.setdefault(entry["folder"], []).append(entry["month"])
    parts = [spark.read.schema(schema).parquet(f"{folder}/{name}/{grain}").filter(_of_months(listed)) for name, listed in months.items()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
