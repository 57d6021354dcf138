"""Byte-level BPE ids of whole texts, with the pieces between merges looked up in a table.

The vocabulary file (a JSON file of the `tokenizers` library) is read where it lies; ids are those of that library. Texts of
Latin letters without apostrophes are cut into pieces with numpy and every distinct piece is encoded once per worker; other texts
go through the encoder whole. Both give the same ids.
"""
from __future__ import annotations

import json
import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import tiktoken

from shelfwise.llm.shingles import mix64, powers

#: The pattern that parts a text before the merges; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
SLOT_BITS = 20
#: Code points below are Latin; their classes are fixed.
LATIN = 0x250
OTHER_SPACE, SPACE, LETTER, NUMBER, OTHER = range(5)


def _byte_of() -> dict[str, int]:
    """Byte by the printable character that stands for it in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> tiktoken.Encoding:
    """The encoder of a vocabulary file, whose ids are in the order of the merges."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    vocabulary = held["model"]["vocab"]
    special = {token["content"]: token["id"] for token in held["added_tokens"]}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): rank for token, rank in vocabulary.items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _classes() -> np.ndarray:
    kinds = np.full(LATIN, OTHER, np.uint8)
    for c in range(LATIN):
        if chr(c).isalpha():
            kinds[c] = LETTER
        elif chr(c) in "0123456789²³¹¼½¾":
            kinds[c] = NUMBER
    kinds[[9, 10, 11, 12, 13, 0x85, 0xA0]] = OTHER_SPACE
    kinds[0x20] = SPACE
    return kinds


class PieceTable:
    """Ids by the hash of a piece: a direct-mapped table, refilled where two pieces share a slot."""

    def __init__(self, path: str):
        self.encoding = encoder(path)
        self.special = self.encoding.encode(SPECIAL, allowed_special="all")[0]
        self.kinds, self.values = _classes(), mix64(np.arange(1, LATIN + 1, dtype=np.uint64))
        size = 1 << SLOT_BITS
        self.keys, self.begin, self.count = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _store(self, slot: int, key: int, ids: list[int]) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.keys[slot], self.begin[slot], self.count[slot] = key, self.used, len(ids)
        self.used += len(ids)

    def simple(self, text: str) -> bool:
        return "'" not in text and SPECIAL not in text and (text.isascii() or max(text) < chr(LATIN))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of simple texts, and where each text's ids begin."""
        if self.used > 1 << 24:
            self.keys[:], self.used = 0, 0
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        kind = self.kinds[points]
        head = np.zeros(len(points) + 1, bool)
        head[bounds] = True
        before = np.concatenate([kind[:1], kind[:-1]])
        gap = kind <= SPACE
        # the last white space before a piece is a piece of its own, or belongs to it if it is a space
        leads = gap & ~np.concatenate([gap[1:], [True]]) & ~head[1:]
        starts = head[:-1] | (gap & (before > SPACE)) | leads | (~gap & ((before == OTHER_SPACE) | ((before > SPACE) & (before != kind))))
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], len(points))
        keys = self._hash(points, at, ends)
        slots = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known = self.keys[slots] == keys
        begin, count = self.begin[slots], self.count[slots]
        missing = np.flatnonzero(~known)
        if len(missing):
            _, first, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
            new_begin, new_count = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
            for i, m in enumerate(missing[first].tolist()):
                self._store(int(slots[m]), keys[m], self.encoding.encode_ordinary(joined[at[m]:ends[m]]))
                new_begin[i], new_count[i] = self.begin[slots[m]], self.count[slots[m]]
            begin[missing], count[missing] = new_begin[inverse], new_count[inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(at, bounds)]

    def _hash(self, points: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        place = np.arange(len(points)) - np.repeat(at, ends - at)
        value = self.values[points] * powers(int(place.max()))[place]
        sums = np.add.reduceat(value, at)
        return mix64(sums + (ends - at).astype(np.uint64)) | np.uint64(1)


def table(path: str) -> PieceTable:
    """The worker's table of a vocabulary: built once per process, not once per task."""
    kept = sys.modules.setdefault("_piece_tables", SimpleNamespace(by_path={}))
    if path not in kept.by_path:
        kept.by_path[path] = PieceTable(path)
    return kept.by_path[path]


def encoded(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a string array (null: none) one after the other, and where each text begins."""
    pieces = table(path)
    texts = ["" if t is None else t for t in column.to_pylist()]
    easy = [pieces.simple(t) for t in texts]
    ids, begins = pieces.many([t if e else "" for t, e in zip(texts, easy)])
    if all(easy):
        return ids, begins
    parts = [ids[begins[i]:begins[i + 1]] if e else pieces.whole(t) for i, (t, e) in enumerate(zip(texts, easy))]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
