"""Column expressions shared by the operators. All of them stay inside the JVM."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The number pattern and the clean date formats decide which raw values parse.
NUMBER_PATTERN = r"(-?\d+(?:\.\d+)?|-?\.\d+)"
CLEAN_DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "d-MMM-yyyy")

# What each letter group of a date format may hold, and the last two-digit year of the 2000s.
DATE_PARTS = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMM": "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", "MM": r"(0[1-9]|1[0-2])",
              "M": r"(0?[1-9]|1[0-2])", "dd": r"(0[1-9]|[12]\d|3[01])", "d": r"(0?[1-9]|[12]\d|3[01])"}
LAST_NEW_YEAR = 2068

# Abramowitz-Stegun 7.1.26 coefficients of the error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

TIE_NUDGE = 1e-9


def to_number(raw: Column) -> Column:
    """First plain number in a text once thousands commas are gone; null when there is none."""
    digits = F.regexp_extract(F.regexp_replace(raw.cast("string"), ",", ""), NUMBER_PATTERN, 1)
    return F.nullif(digits, F.lit("")).try_cast("double")


def strict_number(raw: Column) -> Column:
    """The whole text as a number (surrounding blanks allowed), else null."""
    return F.trim(raw.cast("string")).try_cast("double")


def format_date(text: Column, pattern: str) -> Column:
    """Date of a text that matches the whole format, null for any other text.

    The shape is tested first: the date parser throws and catches an exception for every value that does not fit.
    """
    shape = re.sub("yyyy|yy|MMM|MM|M|dd|d", lambda g: DATE_PARTS[g.group()], pattern.replace(".", r"\."))
    day = F.when(text.rlike(f"(?i)^{shape}$"), F.try_to_timestamp(text, F.lit(pattern)).cast("date"))
    if "yyyy" in pattern:
        return day
    return F.when(F.year(day) > LAST_NEW_YEAR, F.add_months(day, -1200)).otherwise(day)


def parse_date(raw: Column, formats: tuple[str, ...] = CLEAN_DATE_FORMATS) -> Column:
    """First format of the cascade that accepts the value, else null."""
    return F.coalesce(*[format_date(raw, f) for f in formats])


def title_case(text: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    # \x01 marks word starts that initcap would not see; it only splits on blanks.
    spaced = F.regexp_replace(F.lower(text), r"([^\p{L} ])(?=\p{L})", "$1\u0001 ")
    return F.regexp_replace(F.initcap(spaced), "\u0001 ", "")


def half_up(value: Column, digits: int) -> Column:
    """Round half away from zero as NUMERIC does.

    A ratio such as 201/200 has no exact double, so decimal ties are decided by a nudge far below the last kept digit.
    """
    return F.round(value + F.signum(value) * F.lit(TIE_NUDGE), digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; null when the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def positive(value: Column) -> Column:
    """The value where it is above zero, else null."""
    return F.when(value > 0, value)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function through the error function polynomial (error below 1e-7)."""
    scaled = F.abs(x) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * scaled)
    poly = F.lit(ERF_A[-1])
    for a in reversed(ERF_A[:-1]):
        poly = poly * t + F.lit(a)
    erf = F.lit(1.0) - poly * t * F.exp(-scaled * scaled)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(x) * erf)


def json_safe(column: Column, kind: T.DataType) -> Column:
    """NaN and infinities become null, dates become ISO text; everything else is unchanged."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        infinite = F.abs(column) == F.lit(float("inf"))
        return F.when(~(F.isnan(column) | infinite), column)
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    return column
