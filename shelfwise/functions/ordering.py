"""Global order without a global window: running totals, row numbers, ranks, tiles, selected places and exact quantiles.

Running totals and row numbers: rows are range-partitioned by the full sort order, staged with their slice number, and each slice
is numbered on its own. Only the slice totals (one row per partition) meet in one place. Ties in the order must be broken by the caller.

Where a few places of the order are asked for (borders of classes, a median) nothing is sorted: `select_places` brackets each with
a quantile sketch and counts exactly what lies below and inside the brackets.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage

SLICE = "_slice"


def running_totals(df: DataFrame, order: list[Column], values: dict[str, Column], label: str = "ordered") -> DataFrame:
    """Add, per name, the inclusive running total in `order` and `<name>_total`, the grand total."""
    kept = df.columns
    amounts = df.select("*", *[v.alias(f"_v_{name}") for name, v in values.items()])
    sliced = stage(amounts.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id()), label)

    sums = sliced.groupBy(SLICE).agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values])
    everything = Window.partitionBy()
    earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        SLICE,
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.sum(f"_s_{n}").over(everything) * 0).alias(f"_o_{n}") for n in values],
        *[F.sum(f"_s_{n}").over(everything).alias(f"{n}_total") for n in values],
    )
    inside = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one offset row per shuffle partition: bounded by spark.sql.shuffle.partitions, so the broadcast is small
    joined = sliced.join(F.broadcast(offsets), SLICE)
    return joined.select(
        *kept,
        *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}")).alias(n) for n in values],
        *[f"{n}_total" for n in values],
    )


def number_rows(df: DataFrame, order: list[Column], name: str, label: str = "numbered") -> DataFrame:
    """Add the 1-based position in the global order and `<name>_total`, the row count.

    A slice is sorted by the task that gets it, which counts its rows while it stages them: rows are shuffled once.
    """
    kept = df.columns
    at = F.monotonically_increasing_id()                       # the slice above the lowest 33 bits, the row of the slice in them
    sliced = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), label)
    slice_of, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    sizes = sliced.groupBy(slice_of.alias(SLICE)).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(SLICE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"), F.sum("_n").over(Window.partitionBy()).alias(f"{name}_total"))
    # one offset row per shuffle partition, as in running_totals
    joined = sliced.withColumn(SLICE, slice_of).join(F.broadcast(offsets), SLICE)
    return joined.select(*kept, (nth + F.col("_earlier")).alias(name), f"{name}_total")


def number_in_groups(df: DataFrame, groups: list[Column], inside: list[Column], name: str) -> DataFrame:
    """Add the 1-based position in the order of the groups, nulls first, and of `inside` within a group. Nothing is range-sorted.

    For orders whose leading part cuts the rows into groups of bounded size (blocks of a file, days): rows are numbered inside their group
    and get the rows of earlier groups added. One row per group meets in one task; rows are shuffled once, by their group.
    """
    kept = df.columns
    grouped = df.withColumn("_group", F.struct(*[g.alias(f"g{i}") for i, g in enumerate(groups)]))
    counts = grouped.groupBy("_group").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, 0))
    earlier = counts.select("_group", (upto - F.col("_n")).alias("_earlier"))
    numbered = grouped.withColumn("_nth", F.row_number().over(Window.partitionBy("_group").orderBy(*inside)))
    return numbered.join(earlier, "_group").select(*kept, (F.col("_nth") + F.col("_earlier")).alias(name))


def tile(position: Column, total: Column, tiles: int) -> Column:
    """NTILE bucket of a 1-based position: the first `total % tiles` buckets hold one row more."""
    size, extra = F.floor(total / tiles), total % tiles
    wide = extra * (size + 1)
    in_wide = F.ceil(position / (size + 1))
    in_narrow = extra + F.ceil(F.try_divide(position - wide, size))
    return F.when(position <= wide, in_wide).otherwise(in_narrow)


#: Rank error of the sketch is one part in SKETCH; brackets reach a few times as far. Fewer rows are counted without brackets.
SKETCH, BRACKET, SMALL = 10_000, 0.0005, 100_000


@dataclass(frozen=True)
class Place:
    """A place of the ascending order: its value, the rows before all equal ones, and the number of equal ones."""

    value: float
    before: int
    ties: int


def select_places(df: DataFrame, value: Column, places: dict[str, float], at: Callable[[int], dict[str, int]]) -> tuple[int, dict[str, Place]]:
    """Number of rows with a value, and the places that `at` names by 0-based rank once it is known; `places` says roughly where.

    The values are read twice. What meets in one task is a row per distinct value inside a bracket, about a thousandth of the rows for
    each place, and a row for each gap between brackets. Should the sketch have missed a place, all values are counted.
    """
    held = df.select(value.cast("double").alias("_v")).filter("_v IS NOT NULL")
    edges = sorted({min(max(p + d, 0.0), 1.0) for p in places.values() for d in (-BRACKET, BRACKET)})
    sketch = F.percentile_approx("_v", [*edges], SKETCH)
    n, found = held.agg(F.count("*"), sketch).first()
    ranks = {name: rank for name, rank in at(n).items() if 0 <= rank < n}
    low = {name: found[edges.index(min(max(p - BRACKET, 0.0), 1.0))] for name, p in places.items()} if n > SMALL else {}
    high = {name: found[edges.index(min(max(p + BRACKET, 0.0), 1.0))] for name, p in places.items()} if n > SMALL else {}

    def counted(bracketed: bool) -> dict[str, Place]:
        v = F.col("_v")
        inside, gap = F.lit(not bracketed), F.lit(0)
        for name in low if bracketed else ():
            inside = inside | v.between(low[name], high[name])
            gap = gap + (v > high[name]).cast("int")
        groups = held.groupBy(gap.alias("_gap"), F.when(inside, v).alias("_k")).agg(F.count("*").alias("_c"), F.min(v).alias("_least"))
        upto = F.sum("_c").over(Window.orderBy("_least").rowsBetween(Window.unboundedPreceding, 0))
        placed = groups.select("_k", "_c", (upto - F.col("_c")).alias("_before"))
        wanted = F.lit(False)
        for rank in ranks.values():
            wanted = wanted | ((F.col("_before") <= rank) & (F.col("_before") + F.col("_c") > rank))
        rows = placed.filter(wanted & F.col("_k").isNotNull()).collect()          # a row per place at most
        return {name: Place(r["_k"], r["_before"], r["_c"]) for name, rank in ranks.items() for r in rows if r["_before"] <= rank < r["_before"] + r["_c"]}

    picked = counted(bool(low))
    return n, picked if len(picked) == len(ranks) else counted(False)


def rows_at(df: DataFrame, order: list[Column], places: list[int], n: int, label: str) -> dict[int, Row]:
    """The rows at 1-based places of the order of `n` rows, for a few places: sorted by one task where rows are few, else numbered."""
    if n <= SMALL:
        numbered = df.withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    else:
        numbered = number_rows(df, order, "_at", label)
    return {r["_at"]: r for r in numbered.filter(F.col("_at").isin(places)).collect()}


def median(df: DataFrame, value: Column) -> float | None:
    """Exact interpolated median of a whole frame, nulls ignored; None without values."""
    n, picked = select_places(df, value, {"low": 0.5, "high": 0.5}, lambda n: {"low": (n - 1) // 2, "high": n // 2})
    return (picked["low"].value + picked["high"].value) / 2 if n else None


def skip_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """RANK() by `value` descending: one plus the number of rows with a larger value; null values rank nowhere."""
    df = stage(df, "to-rank")
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    ranked = running_totals(counts, [F.col(value).desc()], {"_upto": F.col("_n")}, "ranked")
    ranks = ranked.select(F.col(value).alias("_value"), (F.col("_upto") - F.col("_n") + 1).alias(name))
    return df.join(ranks, df[value] == ranks["_value"], "left").drop("_value")


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key (one row over everything when `keys` is empty), nulls ignored.

    Equal values are counted before the shuffle, so neither a hot key nor a hot value meets in one task.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return quantiles_of_counts(counted, keys, value, "_n", probabilities)


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, count: str, probabilities: dict[str, float]) -> DataFrame:
    """The same from one row per key and value with the number of its rows."""
    counted = counts.filter(F.col(value).isNotNull()).select(*keys, value, F.col(count).alias("_n"))
    order = [*[F.col(k).asc() for k in keys], F.col(value).asc()]
    upto = running_totals(counted, order, {"_upto": F.col("_n")}, "quantiles")

    if keys:
        span = upto.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_n")).alias("_base"), F.sum("_n").alias("_size"))
        placed = upto.join(span, keys)
    else:
        placed = upto.select("*", F.lit(0).cast("bigint").alias("_base"), F.col("_upto_total").alias("_size"))

    first, last = F.col("_upto") - F.col("_n") - F.col("_base"), F.col("_upto") - F.col("_base") - 1
    picks, outputs = [], []
    for name, p in probabilities.items():
        at = (F.col("_size") - 1) * F.lit(p)
        low, high = F.floor(at), F.ceil(at)
        number = F.col(value).cast("double")
        picks += [
            F.max(F.when((first <= low) & (low <= last), number)).alias(f"_lo_{name}"),
            F.max(F.when((first <= high) & (high <= last), number)).alias(f"_hi_{name}"),
            F.max(at - low).alias(f"_w_{name}"),
        ]
        outputs.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")).alias(name))
    return placed.groupBy(*keys).agg(*picks).select(*keys, *outputs)
