import math

import brute
import numpy as np
from pyspark.sql import functions as F

from shelfwise.llm import vector_search

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank int, query_id double"


def check(spark, rows):
    frame = spark.createDataFrame([(i, v, 1, "s", 2, 3.0) for i, v in rows], SCHEMA)
    got = vector_search.top_k(frame, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute.top_k(rows)


def test_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=7)]) for i in range(100)]
    rows += [(100 + i, rows[3][1]) for i in range(50)] + [(200, None), (201, [1.0, None]), (220, [math.nan] * 7), (240, [math.inf] * 7)]
    rows += [(None, rows[5][1]), (260, []), (261, [1.0]), (0, rows[0][1])]
    check(spark, rows)


def test_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 32))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 4] + 0.1 * rng.normal(size=32)]) for i in range(700)]
    monkeypatch.setattr(vector_search, "VECTORS_PER_BLOCK", 100)
    monkeypatch.setattr(vector_search, "QUERIES_PER_BLOCK", 9)
    check(spark, rows)


def test_rows_that_share_an_id_are_others(spark):
    check(spark, [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0]), (0, [0.5, 0.0]), (0, [1.0, 0.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0])])


def test_few_or_no_rows(spark):
    check(spark, [(20, [1.0, 2.0]), (21, [0.5, 0.5])])
    check(spark, [(1, [1.0]), (2, [2.0])])
    check(spark, [])


def test_bound_is_never_below_the_product():
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(30, 64)), rng.normal(size=(50, 64))
    for segments in vector_search.SEGMENTS:
        bound = vector_search.statistics(q, segments) @ vector_search.statistics(v, segments).T
        assert (bound >= q @ v.T - 1e-9).all()
