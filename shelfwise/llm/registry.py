"""Registered queries of this subpackage and their SQL restatements."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import hard_negatives, language_model, licences, line_dedup, line_runs, mixing, near_dedup, packing, periodic, quality_rules, suffix_index, vector_search, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archives": warc.query,
    "op2_licences": licences.query,
    "op3_suffix_dedup": suffix_index.query,
    "op4_repeated_lines": line_dedup.query,
    "op5_context_mixing": language_model.query,
    "op6_mix_sources": mixing.query,
    "op7_quality_rules": quality_rules.query,
    "op8_vector_search": vector_search.query,
    "op9_pack_sequences": packing.query,
    "op10_near_duplicates": near_dedup.query,
    "op11_periodic_runs": periodic.query,
    "op12_frequent_lines": line_runs.query,
    "op13_hard_negatives": hard_negatives.query,
}
#: Queries without an entry are tested against brute force in tests/llm.
SQL: dict[str, str] = {
    "op1_warc_archives": warc.SQL,
    "op2_licences": licences.SQL,
    "op4_repeated_lines": line_dedup.SQL,
    "op6_mix_sources": mixing.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_vector_search": vector_search.SQL,
    "op12_frequent_lines": line_runs.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
