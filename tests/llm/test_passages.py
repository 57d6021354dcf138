"""Repeated passages that start or end inside a line."""
import random

import brute

import corpus_pipeline
from shelfwise.llm import line_dedup


def sentences(seed: str, number: int) -> list[str]:
    return [" ".join(f"{seed}{n}w{k}" for k in range(9)) + "." for n in range(number)]


def repeated_lines(docs):
    return dict(corpus_pipeline.STAGES)["repeated_lines"](docs.sparkSession, docs, "")


def test_a_passage_inside_lines_goes(docs_of):
    shared, a, b = sentences("s", 7), sentences("a", 3), sentences("b", 3)
    # the passage stands in the middle of one line here, over a line end there
    one = " ".join([a[0], *shared, a[1]]) + "\né " + a[2]
    two = " ".join([b[0], *shared[:4]]) + "\n" + " ".join([*shared[4:], b[1]]) + "\n\n" + b[2]
    left = {r["doc_id"]: r for r in repeated_lines(docs_of([(1, one), (2, two), (3, "short. and short.")])).collect()}
    assert left[1]["text"] == one and left[3]["text"] == "short. and short."
    assert left[2]["text"] == f"{b[0]}\n {b[1]}\n\n{b[2]}" and left[2]["n_chars"] == len(left[2]["text"])


def test_a_repeated_line_of_short_sentences_goes_as_a_line(docs_of):
    line = "one two three. four five six! seven eight nine? ten."
    left = {r["doc_id"]: r["text"] for r in repeated_lines(docs_of([(1, line), (2, f"other\n{line}"), (3, f"x {line}")])).collect()}
    assert left == {1: line, 2: "other", 3: f"x {line}"}


def test_sentences_are_cut_without_loss_and_offsets_are_of_bytes(docs_of):
    rng = random.Random(3)
    texts = ["", None, "\n\n", "\na. b\n", "é. 𝄞 ö!\t?  \n\n."] + ["".join(rng.choices("ab.!? \t\né𝄞", k=60)) for _ in range(60)]
    rows = list(enumerate(texts * 2))
    marked = line_dedup.marked(docs_of(rows), line_dedup.SENTENCE, 1).select("_row.doc_id", "_row.text", "n_units", "removed", "kept").collect()
    seen, cut = set(), {i: line_dedup.re.split(line_dedup.SENTENCE, t or "") for i, t in rows}
    gone = {}
    for i, _ in rows:
        gone[i] = [bool(w := tuple(brute.words(u))) and (w in seen or seen.add(w)) is True for u in cut[i]]
    for r in marked:
        i, data = r["doc_id"], (r["text"] or "").encode()
        assert "".join(cut[i]) == (r["text"] or "") and r["n_units"] == len(cut[i])
        assert r["kept"] == "".join(u for u, g in zip(cut[i], gone[i]) if not g)
        assert [data[s["start"]:s["stop"]].decode() for s in r["removed"]] == [u for u, g in zip(cut[i], gone[i]) if g]
