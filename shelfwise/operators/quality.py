"""Data-quality gate: every check is a row (check, violations); the gate is shut while any row is above zero."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.schemas import PAIR, Tables

# Order dates outside these days (bounds excluded) are implausible; the tolerance of revenue.
EARLIEST, LATEST = "2000-01-01", "2100-01-01"
REVENUE_TOLERANCE = 0.011


class DataQualityError(Exception):
    """A table set failed the gate."""


def _fails(condition: Column) -> Column:
    """Rows on which the condition does not hold, null included."""
    return F.count_if(~F.coalesce(condition, F.lit(False)))


def _row_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All checks of one table in one pass, one output row each."""
    counted = df.agg(*[c.cast("bigint").alias(f"c{i}") for i, c in enumerate(checks.values())])
    entries = [F.struct(F.lit(name).alias("check"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("violations"))
               for i, name in enumerate(checks)]
    return counted.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _has_nulls(df: DataFrame) -> Column:
    return F.count_if(F.greatest(*[F.col(c).isNull() for c in df.columns]))


def _repeats(df: DataFrame, keys: list[str], check: str) -> DataFrame:
    """Rows beyond the first of their key."""
    return (df.groupBy(*keys).agg((F.count("*") - 1).alias("extra"))
            .agg(F.lit(check).alias("check"), F.coalesce(F.sum("extra"), F.lit(0)).alias("violations")))


def _orphans(df: DataFrame, dimension: DataFrame, key: str, check: str) -> DataFrame:
    """Rows whose key is not in the dimension; the rows are counted per key before they meet it."""
    per_key = df.groupBy(key).agg(F.count("*").alias("rows"))
    return (per_key.join(dimension.select(key), key, "left_anti")
            .agg(F.lit(check).alias("check"), F.coalesce(F.sum("rows"), F.lit(0)).alias("violations")))


def quality_report(t: Tables, strict: bool = True) -> DataFrame:
    """One row per check. Imported data (`strict=False`) may come without stock and receipts."""
    gap = F.abs(F.col("quantity") * F.col("unit_price") - F.col("revenue"))
    plausible = (F.col("order_date") > F.lit(EARLIEST).cast("date")) & (F.col("order_date") < F.lit(LATEST).cast("date"))
    row_checks = {
        "warehouses": {}, "restocks": {},
        "products": {"products price above cost": _fails(F.col("unit_price") > F.col("unit_cost"))},
        "inventory": {"inventory stock not negative": _fails(F.col("current_stock") >= 0),
                      "inventory reorder level not negative": _fails(F.col("reorder_level") >= 0)},
        "sales": {"sales quantity positive": _fails(F.col("quantity") > 0),
                  "sales unit price positive": _fails(F.col("unit_price") > 0),
                  "sales revenue equals quantity times price": _fails(gap < REVENUE_TOLERANCE),
                  "sales dates plausible": _fails(plausible)},
    }
    required = {"warehouses", "products", "sales"} | ({"inventory", "restocks"} if strict else set())
    parts = []
    for name, df in t.items():
        checks = {f"{name} without nulls": _has_nulls(df), **row_checks[name]}
        if name in required:
            checks = {f"{name} not empty": (F.count("*") == 0).cast("int"), **checks}
        parts.append(_row_checks(df, checks))
    parts += [_repeats(t.warehouses, ["warehouse_id"], "warehouses id unique"),
              _repeats(t.products, ["product_id"], "products id unique"),
              _repeats(t.sales, ["order_id"], "sales order id unique"),
              _repeats(t.inventory, PAIR, "inventory pair unique")]
    for name, df in (("sales", t.sales), ("inventory", t.inventory), ("restocks", t.restocks)):
        parts.append(_orphans(df, t.products, "product_id", f"{name} products known"))
        parts.append(_orphans(df, t.warehouses, "warehouse_id", f"{name} warehouses known"))
    return reduce(DataFrame.unionByName, parts)


def problems(t: Tables, strict: bool = True) -> list[str]:
    """Failed checks, at most one line per check."""
    failed = quality_report(t, strict).filter("violations > 0").orderBy("check").collect()   # bounded by the number of checks
    return [f"{r['check']}: {r['violations']}" for r in failed]


def assert_valid(t: Tables, strict: bool = True) -> None:
    """Raise before anything is written."""
    if found := problems(t, strict):
        raise DataQualityError("; ".join(found))


def stock_ledger(t: Tables) -> DataFrame:
    """Receipts - sold - stock per pair: the difference that a closed ledger has as zero."""
    received = t.restocks.groupBy(*PAIR).agg(F.sum("quantity").alias("received"))
    sold = t.sales.groupBy(*PAIR).agg(F.sum("quantity").alias("sold"))
    held = t.inventory.groupBy(*PAIR).agg(F.sum("current_stock").alias("held"))
    joined = received.join(sold, PAIR, "full").join(held, PAIR, "full").fillna(0, ["received", "sold", "held"])
    return joined.withColumn("difference", F.col("received") - F.col("sold") - F.col("held"))
