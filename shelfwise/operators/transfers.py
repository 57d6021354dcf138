"""Stock transfers between warehouses: greedy allocation, and the plain list of candidates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.schemas import PAIR


def allocate(policy_rows: DataFrame) -> DataFrame:
    """Greedy transfers per product: the biggest deficit takes from the biggest surplus first, ties by warehouse.

    Deficits and surpluses of a product, laid end to end in that order, are two rows of intervals on one axis. Cutting the axis
    at every interval end gives pieces that belong to exactly one deficit and one surplus: the transfers. The windows hold one
    product, whose rows are bounded by the number of warehouses because (warehouse, product) is unique in the stock table.
    """
    deficit = F.greatest(F.col("reorder_point") - F.col("current_stock"), F.lit(0)).cast("bigint")
    surplus = F.greatest(F.col("current_stock") - F.col("reorder_point") - F.col("eoq"), F.lit(0)).cast("bigint")
    sides = policy_rows.select(*PAIR, deficit.alias("deficit"), surplus.alias("surplus"))
    amounts = sides.select(*PAIR, (F.col("deficit") > 0).alias("short"), F.greatest("deficit", "surplus").alias("units"))
    laid = Window.partitionBy("product_id", "short").orderBy(F.desc("units"), "warehouse_id").rowsBetween(
        Window.unboundedPreceding, 0)
    ends = amounts.filter(F.col("units") > 0).withColumn("cut", F.sum("units").over(laid))

    cuts = ends.groupBy("product_id", "cut").agg(
        F.max(F.when(F.col("short"), F.col("warehouse_id"))).alias("to_end"),
        F.max(F.when(~F.col("short"), F.col("warehouse_id"))).alias("from_end"))
    axis = Window.partitionBy("product_id").orderBy("cut")
    ahead = axis.rowsBetween(0, Window.unboundedFollowing)
    pieces = cuts.select(
        "product_id", F.first("from_end", ignorenulls=True).over(ahead).alias("from_warehouse"),
        F.first("to_end", ignorenulls=True).over(ahead).alias("to_warehouse"),
        (F.col("cut") - F.coalesce(F.lag("cut").over(axis), F.lit(0))).alias("quantity"))
    return pieces.filter(F.col("from_warehouse").isNotNull() & F.col("to_warehouse").isNotNull())


def transfer_suggestions(policy_rows: DataFrame, products: DataFrame) -> DataFrame:
    """Allocated transfers with product name and value at cost, most valuable first."""
    named = allocate(policy_rows).join(products.select("product_id", "product_name", "unit_cost"), "product_id")
    value = F.round(F.col("quantity") * F.col("unit_cost"), 2)
    return (named.withColumn("value_at_cost", value).drop("unit_cost")
            .orderBy(F.desc("value_at_cost"), "product_id", "from_warehouse", "to_warehouse"))


def transfer_candidates(inventory: DataFrame, n: int = 20) -> DataFrame:
    """The n largest single moves from a warehouse above twice its reorder level to one below it; a unit may be listed twice.

    Moves are ordered by quantity, then by the larger surplus and deficit. In that order a product's move can only be among the
    first n if both its ends are among the first n + 1 of the product, so only those meet; the rank filter applies before the
    shuffle.
    """
    surplus = F.col("current_stock") - F.col("reorder_level") * 2
    deficit = F.col("reorder_level") - F.col("current_stock")

    def largest(amount: Column, name: str, place: str) -> DataFrame:
        rank = Window.partitionBy("product_id").orderBy(F.desc(name), place)
        return (inventory.select("product_id", F.col("warehouse_id").alias(place), amount.alias(name)).filter(F.col(name) > 0)
                .withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= n + 1).drop("_rank"))

    moves = largest(deficit, "deficit", "to_wh").join(largest(surplus, "surplus", "from_wh"), "product_id")
    return (moves.filter(F.col("from_wh") != F.col("to_wh"))
            .withColumn("transfer_qty", F.least("surplus", "deficit"))
            .orderBy(F.desc("transfer_qty"), F.desc("surplus"), F.desc("deficit"), "product_id", "from_wh", "to_wh").limit(n)
            .select("product_id", "from_wh", "to_wh", "transfer_qty"))
