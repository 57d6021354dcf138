"""Keep-first and keep-last deduplication with an explicit row order.

A filter on row_number() = 1 is limited per task before the shuffle, so a key with a third of all rows sends one row per task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION = "_position"


#: What a reader of files says of a row: its file, the block of the file, and a number that grows inside the block.
PLACED = ["file_path", "file_block_start", "row"]


def is_placed(df: DataFrame) -> bool:
    """Whether the positions of a frame were given by a reader."""
    return POSITION in df.columns and df.select(f"{POSITION}.*").columns == PLACED


def with_position(df: DataFrame) -> DataFrame:
    """Make sure the rows carry a position: file order if the reader gave one, else the order of all columns."""
    if POSITION in df.columns:
        return df
    return df.withColumn(POSITION, F.struct(*df.columns))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(rank)).filter(F.col("_nth") == 1).drop("_nth")


def _places(df: DataFrame) -> list[Column]:
    """What orders the rows: their position, or without one all columns, which then need not be held twice while rows are sorted."""
    return [F.col(POSITION)] if POSITION in df.columns else [F.col(f"`{c}`") for c in df.columns]


def keep_first(df: DataFrame, keys: list[str]) -> DataFrame:
    return first_by(df, keys, [c.asc() for c in _places(df)])


def keep_last(df: DataFrame, keys: list[str]) -> DataFrame:
    return first_by(df, keys, [c.desc() for c in _places(df)])
