import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip(f"no test tables in {SF_DIR}")
    return SF_DIR


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]); further columns have names that operators might use themselves."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", 1.5, "y") for r in rows]
        return spark.createDataFrame(full, DOCS + ", digest string, size double, _row string")

    return make


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])
