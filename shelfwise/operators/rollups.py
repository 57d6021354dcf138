"""Sums of order lines by month that merge: written once by a refresh, they stand in for the order lines they sum.

A frame of sums has the columns of sales that KPIs add up (`quantity`, `revenue`) and the first and last order day of its key in its
month (`order_date`, `last_order_date`). Operators that only add up, or take the month of a day, give the same result over sums as
over lines, as long as they group by keys the sums still have. Three grains are kept: pairs, products and places (warehouses).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.months import LAST_DAY, MONTH, month_of
from shelfwise.schemas import PAIR

#: Keys of the sums besides the month.
GRAINS = {"pairs": PAIR, "products": ["product_id"], "places": ["warehouse_id"]}
#: The columns of sales that sums depend on; a change in others leaves the sums as they are.
SUMMED = ["order_date", *PAIR, "quantity", "revenue"]


def sums_schema(grain: str) -> T.StructType:
    """Columns of the sums of a grain, nullable throughout."""
    kinds = {MONTH: T.StringType(), **{k: T.StringType() for k in GRAINS[grain]}, "lines": T.LongType(), "quantity": T.LongType(),
             "revenue": T.DecimalType(24, 2), "order_date": T.DateType(), LAST_DAY: T.DateType()}
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def _merged(df: DataFrame, grain: str, lines, last: str) -> DataFrame:
    sums = df.groupBy(MONTH, *GRAINS[grain]).agg(
        lines.alias("lines"), F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"),
        F.min("order_date").alias("order_date"), F.max(last).alias(LAST_DAY))
    return sums.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in sums_schema(grain).fields])


def month_sums(sales: DataFrame, grain: str = "pairs") -> DataFrame:
    """Order lines summed by month and the keys of the grain. Lines without a date form a month of their own, null."""
    dated = sales if MONTH in sales.columns else sales.withColumn(MONTH, month_of(F.col("order_date")))
    return _merged(dated.select(MONTH, *SUMMED), grain, F.count("*"), "order_date")


def coarser(sums: DataFrame, grain: str) -> DataFrame:
    """Sums of pairs merged to another grain."""
    return _merged(sums, grain, F.sum("lines"), LAST_DAY)


def month_prints(sales: DataFrame) -> DataFrame:
    """One row per month: its lines, and a print of what the sums depend on that the order of rows and files does not change.

    The print adds up two 64-bit hashes of every line, with different seeds. A row per month and task is shuffled.
    """
    dated = sales if MONTH in sales.columns else sales.withColumn(MONTH, month_of(F.col("order_date")))
    lines = F.struct(*[F.col(c) for c in SUMMED])
    hashes = {"a": F.xxhash64(lines), "b": F.xxhash64(F.lit("second"), lines)}
    added = dated.groupBy(MONTH).agg(F.count("*").alias("lines"), *[F.sum(h.cast("decimal(20,0)")).alias(n) for n, h in hashes.items()])
    return added.select(MONTH, "lines", F.concat_ws(":", "lines", "a", "b").alias("print"))
