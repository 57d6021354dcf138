"""Quality rules, licences, repeated lines, mixing: edge cases and small brute force."""
import re

import brute
from pyspark.sql import functions as F

from shelfwise.llm import licences, line_dedup, mixing, quality_rules

LONG = " ".join(f"w{i}" for i in range(60000))
LINE = "one two three four five six seven eight nine ten eleven"


def test_quality_measures(docs_of):
    texts = [None, "", "a b c d e a b c d e x", "a b c d e f\na b c d e f\n \n# $ x!", LONG, "é ï ö\tß", "- a\n- b\n- c", "a...\nb\nc..."]
    got = {r["doc_id"]: r for r in quality_rules.ledger(docs_of(enumerate(texts))).select("_row.doc_id", "*").collect()}
    for i, text in enumerate(texts):
        t = text or ""
        w = [x for x in re.split(r"[ \t-\r]+", t) if x]
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        seen = {x: windows.count(x) for x in set(windows)} if len(w) < 1000 else {}
        covered = {k + j for k, x in enumerate(windows) if seen.get(x, 1) > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)), text
    assert got[6]["n_bullet_lines"] == 3 and got[7]["n_cut_lines"] == 2


def test_quality_policies(docs_of, empty):
    clean = " ".join(f"word{i}" for i in range(40))
    docs = docs_of([(1, clean), (2, "short"), (3, " ".join(["same"] * 40)), (4, " ".join(f"word{i}!!" for i in range(40))), (None, clean), (1, clean)])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None"]
    assert sorted(str(r["doc_id"]) for r in quality_rules.keep_good(docs, "v1").collect()) == ["1", "1", "4", "None"]
    lost = {r["rule"]: (r["n_failed"], r["n_only_this"]) for r in quality_rules.ablation(quality_rules.ledger(docs)).collect()}
    assert lost["too_few_words"] == (1, 1) and lost["exclamations"] == (1, 1) and lost["repeated_windows"][0] == 1
    assert set(lost) == set(quality_rules.POLICIES["v2"])
    assert quality_rules.keep_good(empty).count() == 0


def test_licence_sequences(docs_of, empty):
    mit = ". ".join(licences.SENTENCES[i] for i in ("mit-grant", "mit-condition", "as-is")) + "."
    wrapped = mit.replace(" of ", " of\n")
    gpl = ". ".join(licences.SENTENCES[i] for i in ("gpl-free", "gpl3-grant", "gpl-hope")) + "."
    rows = [(1, mit), (2, wrapped), (3, gpl + "\n\nReleased under the MIT License."), (4, "the licence of a mit student"), (5, None), (6, ""),
            (7, "Text.\nLicensed under CC BY-NC 4.0.\nMore")]
    got = {r["doc_id"]: r["licences"] for r in licences.licences(docs_of(rows)).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["GPL-3.0-or-later", "MIT"], 4: [], 5: [], 6: [], 7: ["CC-BY-NC-4.0"]}
    assert licences.licences(empty).count() == 0


def test_longer_rules_take_what_they_match(spark):
    known = "".join(f",{i}," for i in ("apache-notice", "apache-compliance", "mit-mention"))
    row = spark.range(1).select(licences._matched(F.lit(known)).alias("x")).first()
    assert row["x"] == ["Apache-2.0", "MIT"]


def test_repeated_lines(docs_of, empty):
    rows = [(3, f"c\n{LINE}\nd"), (1, f"{LINE}\na\n{LINE.upper()}"), (2, LINE), (None, LINE), (4, None), (5, ""), (1, LINE), (6, "a b\n" + LONG)]
    marked = line_dedup.marked(docs_of(rows)).select("_row.doc_id", "n_units", "n_removed", "removed", "kept").collect()
    got = sorted((str(r["doc_id"]), r["n_units"], [(s["start"], s["stop"]) for s in r["removed"]], r["kept"]) for r in marked)
    size = len(LINE)
    assert got == sorted([("3", 3, [(2, 2 + size)], "c\nd"), ("1", 3, [(size + 3, 2 * size + 3)], f"{LINE}\na"), ("2", 1, [(0, size)], ""),
                          ("None", 1, [], LINE), ("4", 1, [], ""), ("5", 1, [], ""), ("1", 1, [], LINE), ("6", 2, [], "a b\n" + LONG)])
    docs = docs_of(rows)
    clean = line_dedup.clean(docs)
    assert clean.columns == docs.columns
    left = {(r["doc_id"], r["text"], r["n_chars"]) for r in clean.collect()}
    assert (3, "c\nd", 3) in left and (4, None, None) in left and 2 not in {r[0] for r in left}
    assert line_dedup.clean(empty).count() == 0


def test_offsets_are_of_bytes(docs_of):
    rows = [(1, LINE), (2, f"é\n{LINE}")]
    row = line_dedup.marked(docs_of(rows)).filter("_row.doc_id = 2").first()
    text = rows[1][1].encode()
    assert [text[s["start"]:s["stop"]].decode() for s in row["removed"]] == [LINE]


def test_targets(spark):
    sizes = [10, 500, 3, 800, 0, 90, 40]
    table = spark.createDataFrame([(f"s{i}", n, 1) for i, n in enumerate(sizes)], "source string, source_size bigint, n bigint")
    got = [r["target"] for r in mixing.targets(table).orderBy("source").collect()]
    want = brute.targets(sizes)
    assert all(abs(a - b) < 1e-6 for a, b in zip(got, want)), (got, want)
    assert abs(sum(got) - sum(sizes)) < 1e-6


def test_mix(docs_of, empty):
    rows = [(i, " ".join(["w"] * (1 + i % 17)), None if i % 3 == 0 else f"s{i % 3}") for i in range(600)] + [(1000, None, "s1"), (1000, None, "s1")]
    docs = docs_of(rows)
    got = mixing.sampled(docs).collect()
    assert len(got) == 601 and all(0 <= r["copies"] <= 3 for r in got)
    for source in (None, "s1", "s2"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 17
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = {(r["doc_id"], r["source"]): r["copies"] for r in got}
    assert mixed.count() == sum(copies[(r[0], r[2])] for r in rows)
    again = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.sampled(docs.repartition(7)).collect()}
    assert again == copies
    assert mixing.mix(empty).count() == 0
