import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import versions
from shelfwise.functions.staging import new_path
from shelfwise.llm import line_runs

GAP = " \t\n\x0b\x0c\r"


def key(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(GAP))


def expected(rows, min_docs, min_chars=1):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                held[key(line)].add(i)
    often = {k for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        out.append((i, len(lines), [n for n, x in enumerate(lines) if key(x) in often], "\n".join(x for x in lines if key(x) not in often)))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r["doc_id"], r["n_lines"], list(r["dropped"]), r["kept"]) for r in frame.select("_row.doc_id", "n_lines", "dropped", "kept").collect()), key=repr)


def test_cases(docs_of):
    long = "\n".join(f"line {i}" if i % 7 else "Common " for i in range(30000))
    rows = [(1, "common\na\n\n"), (2, "\tCOMMON \nb"), (3, long), (4, None), (5, ""), (6, "c\r\ncommon\x0b"), (1, "a\ncommon\nÄ"), (None, "common\nq"),
            (7, "ä"), (8, "Ä x"), (7, "ä"), (9, "Ä X\nä"), (10, "Ä x")]
    docs = docs_of(rows)
    for min_docs in (2, 4):
        assert got(line_runs.drop_frequent(docs, min_docs)) == expected(rows, min_docs), min_docs
    assert got(line_runs.drop_frequent(docs, 3, min_chars=4)) == expected(rows, 3, 4)
    kept = line_runs.clean(docs, 4)
    assert kept.columns == docs.columns
    assert {r["text"] for r in kept.filter("doc_id = 4").collect()} == {None} and kept.filter("doc_id = 2").first()["text"] == "b"


def test_empty_table(empty):
    assert line_runs.drop_frequent(empty).count() == 0


def test_batches_one_by_one_equal_one_batch(spark):
    """Counts that cross the limit in any batch settle; a family can be opened again and extended."""
    rows = [(d, f"k{k}") for d in range(60) for k in range(1, 25) if d % k == 0]
    lines = spark.createDataFrame(rows, "doc_id bigint, word string").select("doc_id", F.unhex(F.md5("word")).alias("digest"), "word")
    folder = new_path(spark, "test-family")
    for b in range(7):
        line_runs.LineRuns(spark, folder).add(lines.filter(F.col("doc_id") % 7 == b))
    runs = line_runs.LineRuns(spark, folder)
    assert sorted(r["level"] for r in runs.runs) == [0, 1, 2]
    settled = [bytes(r[0]) for r in runs.settled().collect()]
    want = lines.groupBy("digest").agg(F.count_distinct("doc_id").alias("n")).filter("n >= 10").collect()
    assert len(settled) == len(set(settled)) and set(settled) == {bytes(r["digest"]) for r in want}
    with pytest.raises(ValueError):
        line_runs.LineRuns(spark, folder, min_docs=3)
    runs.drop()
    assert versions.current(spark, folder) is None


def test_runs_join_without_a_shuffle(spark, monkeypatch):
    """Only the batch is shuffled: twice, by (document, digest) and by digest."""
    lines = spark.range(200).select(F.col("id").alias("doc_id"), F.unhex(F.md5((F.col("id") % 20).cast("string"))).alias("digest"))
    runs = line_runs.LineRuns(spark, new_path(spark, "test-plan"))
    runs.add(lines.filter("doc_id < 50"))
    plans, write = [], line_runs.LineRuns._write
    monkeypatch.setattr(line_runs.LineRuns, "_write", lambda self, rows, level: (
        plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(self, rows, level))[1])
    runs.add(lines.filter("doc_id >= 50"))
    assert [p.count("Exchange ") for p in plans] in ([2, 0], [1, 0]), plans  # a range is known to be distinct
    assert "LeftOuter" in plans[0] and "FullOuter" in plans[1]
    runs.drop()
