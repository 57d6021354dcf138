"""Reading and writing the table set: raw CSV, clean Parquet and CSV, star-schema and result-set exports, JSON records."""
from __future__ import annotations

import uuid
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions import versions
from shelfwise.functions.columns import json_safe
from shelfwise.functions.firsts import POSITION
from shelfwise.functions.months import MONTH, month_of, within, without_month
from shelfwise.functions.staging import CODEC, exists, remove, together
from shelfwise.operators.rollups import month_sums
from shelfwise.schemas import SALES, TABLE_NAMES, TABLE_SCHEMAS, Tables, conform
from shelfwise.sources import sums

DATE_FORMAT = "yyyy-MM-dd"
#: Versions of the clean tables that stay: the one in force, and the one before for readers that have begun.
KEPT_VERSIONS = 2

# Field texts that stand for a missing value in a text export.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
                 "NaN", "None", "n/a", "nan", "null")

# File names of the star-schema export.
STAR_NAMES = {"sales": "fact_sales", "inventory": "fact_inventory", "restocks": "fact_restocks",
              "products": "dim_products", "warehouses": "dim_warehouses"}


# ------------------------------------------------------------------------------------------------ raw
def read_text_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """An untyped CSV with header: every column text, missing texts null, plus the position of each row in its file.

    `multi_line` accepts line breaks inside quotes, at the price of files that cannot be split between tasks.
    """
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    df = df.select("*", "_metadata").withColumns({c: F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")) for c in df.columns})
    where = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn(POSITION, where).drop("_metadata")


def _readable(spark: SparkSession, path: str, kind: str) -> bool:
    try:
        spark.read.format(kind).load(path)
        return True
    except AnalysisException:
        return False


def read_raw(spark: SparkSession, folder: str) -> Tables:
    """The five `raw_<table>.csv` exports; every missing one is named before anything is read."""
    paths = {name: f"{folder}/raw_{name}.csv" for name in TABLE_NAMES}
    missing = [p for p in paths.values() if not _readable(spark, p, "text")]
    if missing:
        raise FileNotFoundError(f"missing raw files: {', '.join(missing)}")
    return Tables(**dict(zip(paths, together(*[partial(read_text_csv, spark, p) for p in paths.values()]))))


# ------------------------------------------------------------------------------------------------ clean tables
def write_tables(tables: Tables, folder: str, csv: bool = True) -> None:
    """One Parquet table per canonical table in a folder of their own, sales by month; CSV copies on request.

    The rebalance hint fills files evenly and splits a month that holds far more rows than the others.
    """
    def write(name: str, df: DataFrame) -> None:
        df = df.select(TABLE_SCHEMAS[name].names)
        if name == "sales":
            monthly = df.withColumn(MONTH, month_of(F.col("order_date"))).hint("rebalance", F.col(MONTH))
            # by product inside a month: row groups of other products are skipped, and days stay within the month anyway
            ordered = monthly.sortWithinPartitions(MONTH, "product_id", "order_date", "order_id")
            ordered.write.mode("overwrite").option("compression", CODEC).partitionBy(MONTH).parquet(f"{folder}/{name}.parquet")
        else:
            df.write.mode("overwrite").option("compression", CODEC).parquet(f"{folder}/{name}.parquet")
        if csv:
            write_csv(df, f"{folder}/{name}.csv")

    together(*[partial(write, name, df) for name, df in tables.items()])


def new_version() -> str:
    """Name of a folder inside the clean folder that no version has."""
    return f"tables-{uuid.uuid4().hex}"


def publish_version(spark: SparkSession, folder: str, version: str, keep: int = KEPT_VERSIONS) -> None:
    """Put the tables of a version folder in force, all at once, with their sums by month; versions before the last `keep` expire.

    Sums of months that did not change are taken over from the version before. Of two writers that began from the same version, the
    slower one fails, so that it cannot name sums which the faster one has let expire.
    """
    number, before = versions.current(spark, folder) or (0, {})
    month_states = sums.write_sums(spark, folder, _read_in(spark, f"{folder}/{version}", "sales"), before.get("sums", []))
    versions.publish(spark, folder, {"tables": version, "sums": month_states}, number)
    numbers = versions.numbers(spark, folder)
    states = {n: versions.read(spark, folder, n) for n in numbers}
    held = {entry["folder"] for n in numbers[-keep:] for entry in states[n].get("sums", [])}
    for n in numbers[:-keep]:
        for name in {states[n]["tables"], *(entry["folder"] for entry in states[n].get("sums", []))} - held:
            remove(spark, f"{folder}/{name}")
        versions.forget(spark, folder, n)


def write_clean(tables: Tables, folder: str, csv: bool = True, keep: int = KEPT_VERSIONS) -> None:
    """Write a new version of the clean tables. Readers see the version before until all five are there."""
    version = new_version()
    write_tables(tables, f"{folder}/{version}", csv)
    publish_version(tables.sales.sparkSession, folder, version, keep)


def version_folder(spark: SparkSession, folder: str) -> str:
    """Where the tables in force lie; a folder without versions holds its tables itself."""
    found = versions.current(spark, folder)
    return f"{folder}/{found[1]['tables']}" if found else folder


def load_sums(spark: SparkSession, folder: str, grain: str) -> DataFrame:
    """Sums by month of the sales in force. Where the version has none (written before there were any), its order lines are summed."""
    found = versions.current(spark, folder)
    if found is None or "sums" not in found[1]:
        return month_sums(_read_in(spark, version_folder(spark, folder), "sales"), grain)
    return sums.read_sums(spark, folder, found[1]["sums"], grain)


def write_csv(df: DataFrame, path: str) -> None:
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    df.write.mode("overwrite").options(**keep).option("header", True).option("dateFormat", DATE_FORMAT).csv(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One clean table of the version in force, in its canonical columns: Parquet if it is there, else CSV."""
    return without_month(_read_in(spark, version_folder(spark, folder), name))


def _read_in(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = TABLE_SCHEMAS[name]
    if exists(spark, f"{folder}/{name}.parquet"):
        if name == "sales":
            schema = T.StructType([*schema.fields, T.StructField(MONTH, T.StringType())])
        return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
    options = {"header": True, "escape": '"', "dateFormat": DATE_FORMAT}
    return spark.read.schema(schema).options(**options).csv(f"{folder}/{name}.csv")


def load_clean(spark: SparkSession, folder: str) -> Tables:
    """All tables of one version. Sales keep their month folder as a last column, by which windows of days skip files."""
    version = version_folder(spark, folder)
    return Tables(**{name: _read_in(spark, version, name) for name in TABLE_NAMES})


def read_sales_between(spark: SparkSession, folder: str, first_day: str, last_day: str) -> DataFrame:
    """Clean sales of a date range; only the month folders it touches are read."""
    sales = _read_in(spark, version_folder(spark, folder), "sales")
    return conform(within(sales, F.lit(first_day).cast("date"), F.lit(last_day).cast("date")), SALES)


def load_data(spark: SparkSession, folders: list[str]) -> tuple[Tables, str]:
    """The first folder of the list that holds clean sales, and its path as the source label."""
    for folder in folders:
        if any(exists(spark, f"{version_folder(spark, folder)}/sales.{kind}") for kind in ("parquet", "csv")):
            return load_clean(spark, folder), folder
    raise FileNotFoundError(f"no clean tables in {', '.join(folders)}")


# ------------------------------------------------------------------------------------------------ exports
def export_star_schema(tables: Tables, folder: str) -> None:
    """Facts and dimensions as CSV under the names of the star schema."""
    for name, df in tables.items():
        write_csv(df.select(TABLE_SCHEMAS[name].names), f"{folder}/{STAR_NAMES[name]}.csv")


def export_result_sets(results: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """One folder per named result set."""
    for name, df in results.items():
        if kind == "csv":
            write_csv(df, f"{folder}/{name}.csv")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_report(report: DataFrame, path: str) -> None:
    """A counter report as JSON."""
    report.write.mode("overwrite").json(path)


def json_columns(schema: T.StructType) -> list[Column]:
    return [json_safe(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields]


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row; NaN and infinities are null, dates are ISO text, null fields stay visible."""
    fields = F.struct(*json_columns(df.schema))
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))
