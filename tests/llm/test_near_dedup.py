import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import near_dedup
from shelfwise.llm.components import components
from shelfwise.llm.shingles import buffers, shingle_sets


def variants(seed: int, number: int, length: int, edits) -> list[str]:
    """Near copies of a text: each has some of its words replaced."""
    rng = random.Random(seed)
    base = [f"b{seed}x{i}" for i in range(length)]
    out = []
    for n in range(number):
        text = list(base)
        for k in range(edits(n)):
            text[rng.randrange(length)] = f"v{n}e{k}"
        out.append(" ".join(text))
    return out


def check(docs_of, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_groups_of_copies(docs_of):
    texts = variants(1, 60, 150, lambda n: n % 5) + variants(2, 30, 12, lambda n: n % 2) + ["A b C"] * 3 + ["a B c", "", None, "x", "one two three four five"]
    rng = random.Random(4)
    rng.shuffle(texts)
    check(docs_of, list(enumerate(texts)))


def test_large_bucket_of_unlinked_copies(docs_of):
    # every copy differs in so many places that few pairs are linked: the block path
    check(docs_of, list(enumerate(variants(3, 150, 160, lambda n: 2 + n % 3))))


def test_edge_cases(docs_of, empty):
    text = " ".join(f"w{i}" for i in range(30))
    docs = docs_of([(5, text), (3, text), (3, text), (None, text), (7, None), (8, ""), (9, "é " + text), (9, "other words of the same id")])
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == sorted([
        ("5", "3", False), ("3", "3", True), ("3", "3", True), ("None", "None", True), ("7", "7", True), ("8", "8", True),
        ("9", "3", False), ("9", "3", False)])
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "3", "7", "8", "None"]
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.85, 0.95):
        both = rng.integers(0, 2**63, int(4000 * share), dtype=np.uint64)
        one, two = (np.unique(np.concatenate([both, rng.integers(0, 2**63, int(2000 * (1 - share)), dtype=np.uint64)])) for _ in range(2))
        regs = near_dedup.sketches([one, two])
        assert near_dedup.estimates(regs[:1], regs[1:])[0] == pytest.approx(share, abs=0.15)


def test_a_word_hash_does_not_depend_on_its_place():
    texts = ["a b c d e f", "zz a b c d e f", "A\tb\nc d e  f ", "é a b c d e f"]
    sets = [set(s.tolist()) for s in shingle_sets(*buffers(pa.array(texts)))]
    assert sets[0] == sets[2] and sets[0] < sets[1] and sets[0] < sets[3]


def test_intersections():
    rng = np.random.default_rng(3)
    one = [np.unique(rng.integers(0, 6000, n).astype(np.uint64)) for n in (1, 40, 3000, 5)]
    two = [np.unique(rng.integers(0, 6000, n).astype(np.uint64)) for n in (2500, 7)]
    assert near_dedup.intersections(one, two).tolist() == [[len(np.intersect1d(a, b)) for b in two] for a in one]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    frame = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}
    assert components(frame.filter("u = v")).count() == 0
