import hashlib
import random
import re
import zlib

import pytest

from shelfwise.llm import periodic


def words(text):
    return [w for w in re.split(r"[ \t-\r]+", text or "") if w]


def all_runs(w, min_length=6, min_exponent=4):
    """(start, period, length) by trying every period at every place."""
    found, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_exponent * q):
                part = w[i:i + length]
                if not any(all(part[k] == part[k + d] for k in range(length - d)) for d in range(1, q)):
                    found.add((i, q, length))
            i = max(j, i) + 1
    return sorted(found)


def collapsed(w, runs):
    gone = {k for s, q, n in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "ab " * 4, "a b " * 4, "a b c " * 4 + "a b", "x " + "a a b " * 9 + "a a c", "a b a b a b c a b a b a b"]
    for k in range(60):
        w = [rng.choice("abc"[:2 + k % 2]) for _ in range(rng.randrange(5, 160))]
        p = rng.randrange(1, 9)
        tail = [rng.choice("abcd") for _ in range(p)]
        w[rng.randrange(len(w)):] = (tail * 30)[:rng.randrange(1, 30 * p + 1)]
        out.append(rng.choice([" ", "\n", "\t "]).join(w + [rng.choice("abcxyz") for _ in range(rng.randrange(9))]))
    word = ["0"]
    for _ in range(7):  # no cubes at all, squares without end
        word = [c for x in word for c in ("01" if x == "0" else "10")]
    return out + [" ".join(word), " ".join("0 1 0 0 1".split() * 13)]


@pytest.mark.parametrize("limits", [(6, 4), (1, 2), (4, 3), (9, 2.5)])
def test_against_every_period(docs_of, limits):
    rows = list(enumerate(texts()))
    got = periodic.periodic_runs(docs_of(rows), *limits).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words(rows[r["doc_id"]][1])
        want = all_runs(w, *limits)
        assert (r["n_words"], [tuple(x) for x in r["runs"]]) == (len(w), want), rows[r["doc_id"]]
        assert r["collapsed"] == collapsed(w, want)


def test_long_texts(docs_of):
    """One word again and again, a long period, and no repeat at all; rows that share an id or have none."""
    n = 60000
    rows = [(1, "w " * n), (2, " ".join(f"w{i % 7001}" for i in range(n))), (2, " ".join(f"w{i}" for i in range(n))), (None, "a " * 6), (None, None)]
    got = sorted((r["n_words"], [tuple(x) for x in r["runs"]], len(words(r["collapsed"]))) for r in periodic.periodic_runs(docs_of(rows)).collect())
    assert got == [(0, [], 0), (6, [(0, 1, 6)], 1), (n, [], n), (n, [(0, 1, n)], 1), (n, [(0, 7001, n)], 7001)]


def test_empty_table(empty):
    assert periodic.periodic_runs(empty).count() == 0


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        w = words(d["text"])
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        # only periods whose words recur are tried: a run's first word stands again a period later
        runs = all_runs(w) if n < 1500 else None
        if runs is not None:
            top = max(runs, key=lambda r: (r[2] / r[1], -r[0], -r[1]), default=None)
            best = (None,) * 4 if top is None else (top[0], top[2], top[1], 1000 * top[2] // top[1])
            want[d["doc_id"]] = (len(runs), *best, digest("".join(f"{s},{k},{q}\n" for s, q, k in runs)), digest(collapsed(w, runs)))
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic.query(spark, sf_dir).collect()}
    assert len(got) == len(docs) and sum(r[0] > 0 for r in want.values()) > 5
    assert {i: got[i] for i in want} == want
