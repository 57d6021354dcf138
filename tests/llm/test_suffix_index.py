import random

import brute
import numpy as np
from pyspark.sql import functions as F

from shelfwise.llm import suffix_index
from shelfwise.llm.suffix_index import Entries, LevelFamily


def check(docs_of, rows):
    frame = suffix_index.removed_repeats(docs_of(rows))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    got = {r[0]: tuple(r[1:]) for r in frame.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()}
    assert got == brute.removed_repeats(rows)


def test_shared_passages(docs_of):
    rng = random.Random(5)
    letters = "abcdefgh é"
    passage = ["".join(rng.choice(letters) for _ in range(n)) for n in (49, 50, 51, 75, 400, 3000)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passage)
            a = rng.randrange(len(p))
            parts += ["".join(rng.choice(letters) for _ in range(rng.randrange(40))), p if rng.random() < 0.6 else p[a:a + rng.randrange(120)]]
        rows.append((i * 7 % 61, "".join(parts)))
    check(docs_of, rows + [(100, None), (101, ""), (102, "a" * 300), (103, "a" * 60), (104, rows[3][1])])


def test_long_text_over_chunks(docs_of, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("abcd ") for _ in range(9000))
    monkeypatch.setattr(suffix_index, "CHUNK", 2048)
    check(docs_of, [(1, long), (2, "x" + long[100:7000]), (3, long[1990:2100]), (4, long[4000:4049]), (5, long[4000:4050])])


def test_ids(docs_of, empty):
    text = "".join(chr(97 + i * i % 23) for i in range(200))
    rows = suffix_index.removed_repeats(docs_of([(2, text), (2, text), (None, text), (1, text)])).collect()
    assert sorted((str(r["doc_id"]), bytes(r["kept"]).decode()) for r in rows) == sorted([("2", ""), ("2", ""), ("None", text), ("1", text)])
    assert suffix_index.removed_repeats(empty).count() == 0


def test_levels_stay_few():
    rng, family, want = np.random.default_rng(1), LevelFamily(), {}
    for batch in range(64):
        hashes = rng.integers(0, 3000, 100).astype(np.uint64)
        for h in hashes.tolist():
            n, first = want.get(h, (0, batch))
            want[h] = (n + 1, min(first, batch))
        family.add(Entries.of(hashes, np.ones(100, np.int64), np.full(100, batch)))
        assert len(family.levels) <= 8
    whole = family.whole()
    assert {h: (n, f) for h, n, f in zip(*(x.tolist() for x in whole.fields()))} == want
