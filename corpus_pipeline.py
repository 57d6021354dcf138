"""Corpus preparation: quality rules, near-duplicate removal, repeated lines, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.functions.staging import stage
from shelfwise.llm import line_dedup, mixing, near_dedup, packing, quality_rules

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", lambda spark, docs, sf_dir: quality_rules.keep_good(docs)),
    ("near_duplicates", lambda spark, docs, sf_dir: near_dedup.keep_one(docs, near_dedup.Threshold(80))),
    ("repeated_lines", lambda spark, docs, sf_dir: line_dedup.clean_passages(docs)),
    ("mix_sources", lambda spark, docs, sf_dir: mixing.mix(docs)),
    ("pack_sequences", lambda spark, docs, sf_dir: packing.pack(docs)),
]

#: Tokenizing and near-duplicate components have no SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
