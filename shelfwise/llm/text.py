"""Column expressions on text that several operators share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
ROW = "_row"


def whole(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Words in order: maximal runs without ASCII white space."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as bigint, without building them all: pieces between gaps, less an empty first and last piece."""
    inner = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, GAP))).cast("bigint")


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once: a lambda variable is not substituted by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_row(df: DataFrame, *columns: Column) -> DataFrame:
    """The whole row packed into one column, so that added columns cannot clash with those of the input."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias(ROW), *columns)
