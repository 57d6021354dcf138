"""The stages against plain restatements, each on its own input."""
import re
from collections import Counter

import brute
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shelfwise.functions.staging import stage
from shelfwise.llm import line_dedup, mixing, packing, quality_rules


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before and after every stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        after = stage(function(spark, docs, sf_dir), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def rows(frame):
    return [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]


def test_columns(stages, spark, sf_dir):
    want = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert [after.columns == want for _, after in stages.values()] == [True] * 4 + [False]


def test_quality(stages, spark, sf_dir):
    before, after = stages["quality_rules"]
    good = quality_rules.ledger(before).filter(quality_rules.verdict()).select("_row.doc_id")
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(r[0] for r in good.collect())
    # clean documents stay, junk goes
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r[0] for r in rows(after)}
    long = [i for i, t, _ in rows(before) if i in labels and len(brute.words(t)) >= 10]
    assert [i for i in long if labels[i] == 1 and i not in kept] == []
    assert not any(i in kept for i in long if labels[i] == 0)


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    found = brute.near_duplicates([(i, t) for i, t, _ in rows(before)], 80)
    assert sorted(rows(after), key=str) == sorted([r for r in rows(before) if found[r[0]][1] == r[0]], key=str)


def test_repeated_lines(stages):
    before, after = stages["repeated_lines"]
    seen, said, want = set(), set(), []
    for i, text, source in sorted(rows(before)):
        kept = []
        for line in text.split("\n"):
            norm = tuple(line_dedup.normalised(line))
            if len(norm) >= line_dedup.MIN_WORDS:
                if norm in seen:
                    continue
                seen.add(norm)
            rest = ""
            for sentence in re.split(r"(?<=[.!?])(?=[ \t])", line):
                norm = tuple(line_dedup.normalised(sentence))
                if len(norm) < line_dedup.SENTENCE_WORDS or norm not in said:
                    rest += sentence
                if len(norm) >= line_dedup.SENTENCE_WORDS:
                    said.add(norm)
            kept.append(rest)
        left = "\n".join(kept)
        if left == text or brute.words(left):
            want.append((i, left, source))
    assert sorted(rows(after)) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["text"] != dict((i, t) for i, t, _ in rows(before))[r["doc_id"]])


def test_mix(stages):
    before, after = stages["mix_sources"]
    size = {i: len(brute.words(t)) for i, t, _ in rows(before)}
    sources = sorted({s for _, _, s in rows(before)})
    total = [sum(size[i] for i, _, s in rows(before) if s == source) for source in sources]
    copies = Counter(i for i, _, _ in rows(after))
    assert max(copies.values()) <= mixing.MOST
    for source, target in zip(sources, brute.targets(total)):
        own = {i for i, _, s in rows(before) if s == source}
        assert abs(sum(copies[i] * size[i] for i in own) - target) <= 2 * max(size[i] for i in own)


def test_packing(stages):
    before, after = stages["pack_sequences"]
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    need = Counter({i: 0 for i, _, _ in rows(before)})
    for i, text, _ in rows(before):
        need[i] += len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    got, fill = Counter(), Counter()
    for r in after.collect():
        got[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]] += r["length"]
    assert got == need and max(fill.values()) <= packing.LENGTH
    assert len(fill) == brute.best_fit(Counter(r["length"] for r in after.collect()), packing.LENGTH)


def test_run(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages["pack_sequences"][1].collect()))
