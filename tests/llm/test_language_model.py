import random

import brute
import numpy as np
import pytest

from shelfwise.llm import language_model
from shelfwise.llm.language_model import GATES, MAP_CELLS, Mixer, Predictors, context_keys, events


def corpus(seed: int, number: int):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed"]
    return [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120)))) for i in range(number)]


def test_base_score_and_held_out_bits(docs_of):
    rows = corpus(1, 300) + [(1000, None), (1001, ""), (1002, "A\tb  \n"), (1003, "xé " * 3000)]
    got = {r["doc_id"]: r for r in language_model.scores(docs_of(rows)).collect()}
    want = brute.unigram(rows)
    for i, (held, n, known, train, score) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train), i
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
    unseen = [i for i, w in want.items() if w[0] and i < 300]
    assert len(unseen) > 15
    assert sum(got[i]["score"] for i in unseen) > sum(got[i]["base_score"] for i in unseen)
    # shuffled letters are less likely than the text they come from
    rng = random.Random(2)
    other = rows + [(5000 + i, "".join(rng.sample(rows[i][1], len(rows[i][1])))) for i in unseen]
    again = {r["doc_id"]: r["score"] for r in language_model.scores(docs_of(other)).collect()}
    assert all(again[5000 + i] < again[i] for i in unseen)


def codes_of(*texts):
    data = [t.encode() for t in texts]
    out = list(events(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)))
    return [np.concatenate(x) for x in zip(*out)]


def test_scores_against_a_plain_model(docs_of):
    rows = corpus(3, 60) + [(100, None), (101, ""), (102, "The\tEND  \n"), (103, "naïve café"), (104, "unheard 1234567 symbols")]
    rows += [(105, rows[4][1]), (105, "same id"), (106, "ha" * 200)]
    want = brute.mixed(rows)
    got = sorted((r["doc_id"], r["score"]) for r in language_model.scores(docs_of(rows)).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-5)


def test_shards_lose_no_count(docs_of, monkeypatch):
    """The same corpus in many shards and batches: training counts are the same; only the learned weights differ."""
    monkeypatch.setattr(language_model, "STEPS", 10**9)
    monkeypatch.setattr(language_model, "RATE", 0.0)
    monkeypatch.setattr(language_model, "MAP_RATE", 0.0)
    rows = corpus(5, 200)
    one = {r["doc_id"]: r["score"] for r in language_model.scores(docs_of(rows)).collect()}
    monkeypatch.setattr(language_model, "SHARD_BYTES", 4000)
    many = {r["doc_id"]: r["score"] for r in language_model.scores(docs_of(rows).repartition(5)).collect()}
    assert many == pytest.approx(one, rel=1e-6)


def test_a_text_longer_than_a_piece(docs_of, monkeypatch):
    text = corpus(7, 1)[0][1] * 20
    whole = codes_of(text, "x")
    monkeypatch.setattr(language_model, "CHUNK", 1000)
    assert all((a == b).all() for a, b in zip(whole, codes_of(text, "x")))


def test_probabilities_of_the_next_byte_add_up():
    rng = np.random.default_rng(1)
    code = np.unique(rng.integers(0, 4, (3000, 6)).astype(np.uint64) @ (np.uint64(256) ** np.arange(6, dtype=np.uint64)))
    history = np.uint64(0x010203010200)
    every = np.unique(np.concatenate([code, history | np.arange(256, dtype=np.uint64)]))
    keys, counts = language_model._counted(context_keys(every).ravel(), np.tile(np.isin(every, code) * 3, language_model.INPUTS))
    bits = Mixer.fresh().bits(Predictors.of(keys, counts), history | np.arange(256, dtype=np.uint64))
    assert (2.0**bits).sum() == pytest.approx(1, abs=1e-6)


def test_events_do_not_look_ahead_or_depend_on_neighbours():
    doc, code = codes_of("abc def", "", "Abc deX")
    one, two = (np.flatnonzero(doc == d) for d in (0, 2))
    assert len(one) == 8 and (doc == 1).sum() == 1
    assert (language_model._straight(code) & np.uint64(0xFFFF)).tolist()[1] == int.from_bytes(b"ab", "big")
    assert code[one[:6]].tolist() == code[two[:6]].tolist()
    assert [int(c & np.uint64(255)) for c in code[one]] == [*b"abc def", 0xFF]
    # the word so far: 'a' after the start and 'd' after a gap have contexts of their own kind
    word = context_keys(code[one])[-1]
    assert [int(k >> np.uint64(56)) - language_model.INPUTS for k in word] == [0, 1, 2, 3, 0, 1, 2, 3]


def test_learning_improves_the_mix():
    rng = np.random.default_rng(4)
    code = np.sort(rng.choice(np.array([0x616161616162, 0x616161616263, 0x626262626161], np.uint64), 4000))
    keys, counts = language_model._counted(context_keys(code).ravel(), np.ones(len(code) * language_model.INPUTS, np.int64))
    predictors, mixer = Predictors.of(keys, counts), Mixer.fresh()
    before = mixer.bits(predictors, code).sum()
    tally = [np.zeros(GATES), np.zeros((GATES, MAP_CELLS))]
    for a in range(0, 4000, 500):
        mixer.bits(predictors, code[a:a + 500], np.ones(500), tally)
    assert mixer.bits(predictors, code).sum() > before


def test_few_or_no_documents(docs_of, empty):
    assert language_model.scores(empty).count() == 0
    rows = language_model.scores(docs_of([(None, "a b"), (None, None)])).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and np.isfinite(r["base_score"]) and r["score"] < 0 for r in rows)


def test_packed_codes_and_counts():
    rng = np.random.default_rng(6)
    codes = np.unique(np.concatenate([rng.integers(0, 2**48, 500).astype(np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]]))
    counts = rng.choice([0, 1, 254, 255, 256, 10**12], len(codes))
    assert (language_model._unpacked(language_model._packed(codes)) == codes).all()
    assert (language_model._counts_unpacked(language_model._counts_packed(counts)) == counts).all()
    logs = rng.normal(size=len(codes)).astype(np.float32)
    assert (language_model._logs_unpacked(language_model._logs_packed(logs), len(logs)) == logs).all()
    assert not len(language_model._unpacked(language_model._packed(codes[:0])))
    assert not len(language_model._counts_unpacked(language_model._counts_packed(counts[:0])))
