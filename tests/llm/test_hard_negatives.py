import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank int, anchor_id double, cell int"


def expected(rows, n_positives=5, n_negatives=5, floor_percent=80):
    good = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, x) in enumerate(good):
        if i % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), j, other) for b, (j, other, y) in enumerate(good) if b != a]
        for top, j, _ in sorted(s for s in scored if s[2] == lab)[:n_positives]:
            inside = sorted(s[:2] for s in scored if s[2] != lab and floor_percent * -top <= 100 * -s[0] <= 100 * -top)
            out += [(i, j, n + 1, k, -top, -s) for n, (s, k) in enumerate(inside[:n_negatives])]
    return sorted(out)


def check(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, lab, "s", 2, 3.0, 4) for i, v, lab in rows], SCHEMA)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, **options)
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, **options)


def vectors(rng, n, spread=0.4, width=8):
    centres = rng.normal(size=(3, width))
    return [[float(np.float32(x)) for x in centres[k % 3] + spread * rng.normal(size=width)] for k in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hard_negatives, "VECTORS_PER_BLOCK", 37)
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_GROUP", 2)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    v = vectors(rng, 130)
    rows = [(i, v[i], i % 4) for i in range(130)] + [(100, v[7], 2), (0, v[3], 0), (5, v[5], 1), (5, v[5], 1)]
    rows += [(200, None, 1), (300, [], 1), (400, [1.0, None], 1), (500, [math.nan] * 8, 1), (600, [math.inf], 1), (700, [1.0], None),
             (None, v[1], 1), (800, [0.5], 2), (900, [float(2**20)] * 4, 3)]
    check(spark, rows)
    check(spark, rows, n_positives=2, n_negatives=9, floor_percent=30)


def test_blocks_and_a_hot_vector(spark, small_blocks):
    """A third of the rows are one vector: equal scores are cut by vec_id, in blocks and at the end."""
    rng = np.random.default_rng(2)
    v = vectors(rng, 400)
    rows = [(i, v[7] if i % 3 == 0 else v[i], (i // 3) % 5 if i % 3 == 0 else 1 + i % 2) for i in range(400)]
    check(spark, rows)


def test_few_or_no_rows(spark):
    check(spark, [])
    check(spark, [(100, [1.0], 1)])
    check(spark, [(100, [1.0], 1), (101, [1.0], 1), (102, [1.0], 2)])
    check(spark, [(100, [-1.0], 1), (101, [1.0], 1), (102, [1.0], 2)])


def test_keys_sort_by_score_then_kind_then_id():
    rows = [({"anchor": 1, "anchor_id": 100, "score": s, "vec_id": i}, kind) for s in (5, -5, 0, 2**40) for kind in (0, 1) for i in (-3, 0, 2**50)]
    by_bytes = sorted(rows, key=lambda r: hard_negatives._key(*r))
    assert by_bytes == sorted(rows, key=lambda r: (-r[0]["score"], r[1], r[0]["vec_id"]))
