import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import packing
from shelfwise.llm.tokens import encoded

ODD = ["", "a  b", "  \n\n x\n y \t\t", "it's we'll 's x", "<|endoftext|> a<|endoftext|>", "日本語 テスト mix", "a\x85b\xa0c \xa0 d\x1c\x1fe",
       "x² ½ ١٢ ǅ ª º", "\n", " a \n b", "ab​cd", "12abc34 ,,.. !a", "À×÷ ×", "´¨ˆ˜"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.VOCABULARY)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(tokenizer):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\t\x85\xa0abÀ×1²,.!'´ªºʰˆ́Ǆ") for _ in range(rng.randrange(40))) for _ in range(1500)]
    ids, begins = encoded(pa.array([*texts, None]), packing.VOCABULARY)
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])] == [ids_of(tokenizer, t) for t in [*texts, None]]


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 17, 64])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randrange(12))}
        place, held = {}, defaultdict(list)
        for size, first, last, each, sequence, at in packing.plan(counts, capacity):
            for rank in range(first, last):
                assert rank not in place
                place[rank] = size
                held[sequence + (rank - first) // each].append((at + (rank - first) % each * size, size))
        assert [place[r] for r in sorted(place)] == [size for size in sorted(counts, reverse=True) for _ in range(counts[size])]
        for pieces in held.values():
            end = 0
            for at, size in sorted(pieces):
                assert at == end
                end += size
            assert end <= capacity
        assert len(held) == brute.best_fit(counts, capacity)


def test_pack(docs_of, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "of", "Word", "éa", "x9"]) for _ in range(rng.randrange(400)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "a b c " * 2500), (203, "same"), (203, "same"), (None, "no id"), *[(300 + i, t) for i, t in enumerate(ODD)]]
    packed = packing.pack(docs_of(rows), with_ids=True).cache()
    sequence = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(packed).collect()}
    assert all(len(s) <= packing.LENGTH for s in sequence.values())
    pieces, counts = defaultdict(list), defaultdict(int)
    for r in packed.collect():
        ids = sequence[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], ids))
        counts[r["length"]] += 1
    assert len(sequence) == brute.best_fit(counts, packing.LENGTH)
    for doc_id, text in rows:
        want = [*ids_of(tokenizer, text), packing.END]
        own = sorted(pieces[doc_id])[::2 if doc_id == 203 else 1]
        assert [x for _, start, ids in own for x in ids] == want
        assert [len(ids) for _, _, ids in own][1:] == [packing.LENGTH] * (len(own) - 1)


def test_no_documents(empty):
    assert packing.pack(empty).count() == 0
