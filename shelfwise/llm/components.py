"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage


def _written(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and a mark of its rows taken in the same job."""
    seen = Observation()
    observed = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    return stage(observed, label), tuple(seen.get.values())


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and its neighbours. The centre of a large star is one row of the aggregate."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
    return edges.join(least, edges["u"] == least["_u"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (u, v); the component is its smallest node. Loops are allowed."""
    ordered = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = _written(ordered, "edges")
    while mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = _least_neighbour(large)
        joined = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v")
        before = mark
        now, mark = _written(joined.distinct(), "stars")
        if mark == before:
            break
    # every node but the centres now has one edge, to its centre
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
