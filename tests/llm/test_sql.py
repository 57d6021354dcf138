"""Queries that have SQL against it, all others for a stable result."""
import pytest
from compare import connect, differences

import __spark_entry__ as entry
from shelfwise.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf_dir, name):
    assert differences(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.SQL[name]) is None


def test_all_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(registry.SQL) <= set(registry.QUERIES)
