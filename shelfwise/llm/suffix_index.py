"""Removal of long byte strings that start in an earlier document, by a logarithmic family of sparse suffix arrays (operator 3).

Suffixes are sampled: of the `KEY`-byte strings inside every `SPAN`-byte string, the one with the least hash names a position, so two
equal spans always sample the same position in them, and about one position in fourteen is sampled. A batch of documents gives a
suffix array of its samples, sorted by the fingerprint of the first `KEY` bytes. Arrays are cut into shards by fingerprint; in a
shard, each new batch is added to a family of levels, and levels of like size are merged, so an entry is merged a logarithmic
number of times. The scan of the family against the batches tells which samples recur.

What recurs is extended to exact matches in two more rounds over the same kind of family, keyed by longer strings: first the
whole stretch of spans that share a sample (one entry per sample settles matches inside long repeats), then, where stretches with
the same sample differ, the single spans. A key, stretch or span that stands in a third of all documents is one entry per batch.
Strings are compared by 64-bit fingerprints. Between rounds only fingerprints and text batches move, all in the shared folder.

Defined cases: a null text is empty; documents without an id keep all their bytes and count for nobody; rows that share a doc_id are
the same document, of which none is earlier; an empty table gives no rows; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage
from shelfwise.llm.batches import by_batch, opened, text_batches
from shelfwise.llm.shingles import VALUE, mix64, powers

SPAN = 50
KEY = 24
WIDTH = SPAN - KEY + 1
#: Bytes hashed at once, and bytes of text whose samples make a shard.
CHUNK = 1 << 19
SHARD_BYTES = 8 << 20
#: Rounds of the family: sampled suffixes, stretches of spans around a sample, single spans.
SAMPLE, STRETCH, SINGLE = range(3)

ENTRIES = "shard int, batch bigint, hashes binary, counts binary, firsts binary"
SHARED = "batch bigint, round int, hashes binary, counts binary, firsts binary"
RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
NONE = np.iinfo(np.int64).max


@dataclass
class Entries:
    """Sorted fingerprints with the number of documents (or document and stretch pairs) and the smallest doc_id."""
    hashes: np.ndarray
    counts: np.ndarray
    firsts: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> Entries:
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        if not len(heads):
            return Entries(hashes, counts, firsts)
        return Entries(hashes[heads], np.add.reduceat(counts[order], heads), np.minimum.reduceat(firsts[order], heads))

    def merged(self, other: Entries) -> Entries:
        return Entries.of(*[np.concatenate(pair) for pair in zip(self.fields(), other.fields())])

    def fields(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.hashes, self.counts, self.firsts

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each fingerprint: whether it is here, its count and first; 1 and no document where it is not."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.ones(len(hashes), np.int64), np.full(len(hashes), NONE)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        here = self.hashes[at] == hashes
        return here, np.where(here, self.counts[at], 1), np.where(here, self.firsts[at], NONE)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.hashes.tobytes(), self.counts.astype(np.uint32).tobytes(), self.firsts.tobytes()

    @staticmethod
    def unpacked(hashes: bytes, counts: bytes, firsts: bytes) -> Entries:
        return Entries(np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64), np.frombuffer(firsts, np.int64))


EMPTY = Entries(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


class LevelFamily:
    """Sorted levels of falling size; a new batch is merged with every level that is not larger than twice its size."""

    def __init__(self):
        self.levels: list[Entries] = []

    def add(self, batch: Entries) -> None:
        while self.levels and len(self.levels[-1].hashes) <= 2 * len(batch.hashes):
            batch = self.levels.pop().merged(batch)
        self.levels.append(batch)

    def whole(self) -> Entries:
        """All levels as one."""
        out = EMPTY
        for level in reversed(self.levels):
            out = out.merged(level)
        return out


@dataclass
class Scan:
    """Samples of a chunk: the document, its first span's start in the document and in the chunk, number of spans, fingerprints."""
    doc: np.ndarray
    start: np.ndarray
    at: np.ndarray
    number: np.ndarray
    key: np.ndarray
    stretch: np.ndarray
    sums: np.ndarray

    def singles(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All spans of the chosen samples: the number of the sample, the place of the span among its spans."""
        number = self.number[chosen]
        of = np.repeat(chosen, number)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)

    def span_hashes(self, of: np.ndarray, nth: np.ndarray) -> np.ndarray:
        begin = self.at[of] + nth
        return _hash(self.sums, begin, begin + SPAN)


def _hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of chunk[a:b], independent of where they stand."""
    return mix64((sums[b] - sums[a]) * powers(CHUNK + SPAN)[CHUNK + SPAN - a] + (b - a).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` values."""
    length = 1
    while 2 * length <= width:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    return np.minimum(values[:len(values) - (width - length)], values[width - length:]) if width > length else values


def _chunks(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, from, to) that are hashed together. Long documents are cut, each part with the bytes its last spans need."""
    held, size = [], 0
    room = CHUNK - SPAN
    for doc, length in enumerate(np.diff(offsets).tolist()):
        for begin in range(0, max(length - SPAN + 1, 0), room):
            end = min(begin + room + SPAN - 1, length)
            if held and size + end - begin > CHUNK:
                yield held
                held, size = [], 0
            held.append((doc, begin, end))
            size += end - begin
    if held:
        yield held


def scans(data: np.ndarray, offsets: np.ndarray) -> Iterator[Scan]:
    for parts in _chunks(offsets):
        chunk = np.concatenate([data[offsets[d] + a:offsets[d] + b] for d, a, b in parts])
        n = len(chunk)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUE[chunk] * powers(CHUNK + SPAN)[:n], out=sums[1:])
        begin = np.arange(n - KEY + 1)
        keys = _hash(sums, begin, begin + KEY)
        # the place of the least key in every span, the first of equals
        order = (keys & np.uint64(0xFFFFFFFF00000000)) | begin.astype(np.uint64)
        chosen = (_least(order, WIDTH) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lengths = np.array([b - a for _, a, b in parts])
        bounds = np.cumsum(lengths) - lengths
        part = np.repeat(np.arange(len(parts)), lengths - SPAN + 1)
        within = np.arange(len(part)) - np.repeat(np.cumsum(lengths - SPAN + 1) - (lengths - SPAN + 1), lengths - SPAN + 1)
        spans = bounds[part] + within
        place = chosen[spans]
        head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1])]))
        number = np.diff(np.append(head, len(spans)))
        at = spans[head]
        which = np.array(parts)[part[head]]
        yield Scan(which[:, 0], which[:, 1] + within[head], at, number, keys[place[head]], _hash(sums, at, at + number + SPAN - 1), sums)


def _distinct(hashes: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """One index per distinct combination."""
    mixed = hashes
    for other in others:
        mixed = mix64(mixed * np.uint64(3) + other.astype(np.uint64))
    return np.unique(mixed, return_index=True)[1]


def _known(table: pa.Table) -> list[Entries]:
    """What the rounds so far have found for a batch."""
    found: list[list[tuple]] = [[], [], []]
    for row in table.to_pylist():
        found[row["round"]].append(Entries.unpacked(row["hashes"], row["counts"], row["firsts"]).fields())
    return [Entries.of(*[np.concatenate(x) for x in zip(*rows)]) if rows else EMPTY for rows in found]


def _judge(scan: Scan, ids: np.ndarray, known: list[Entries]) -> tuple[np.ndarray, np.ndarray]:
    """Samples whose stretch starts in an earlier document, and those whose spans must be looked at one by one."""
    active, pairs, _ = known[SAMPLE].find(scan.key)
    _, same, first = known[STRETCH].find(scan.stretch)
    settled = active & (first < ids[scan.doc])
    return settled, np.flatnonzero(active & ~settled & (same < pairs))


def _entries(rows: list[dict], known: list[Entries], step: int) -> Entries:
    """A batch's entries of a round."""
    parts = []
    for ids, has_id, offsets, data in map(opened, rows):
        for scan in scans(data, offsets):
            usable = has_id[scan.doc]
            doc = ids[scan.doc]
            if step == SAMPLE:
                pick = np.flatnonzero(usable)
                one = pick[_distinct(scan.key[pick], scan.stretch[pick], doc[pick])]
                # who holds a sample first is not asked
                parts.append((scan.key[one], np.zeros(len(one), np.int64)))
            elif step == STRETCH:
                pick = np.flatnonzero(usable & known[SAMPLE].find(scan.key)[0])
                one = pick[_distinct(scan.stretch[pick], doc[pick])]
                parts.append((scan.stretch[one], doc[one]))
            else:
                _, asked = _judge(scan, ids, known)
                of, nth = scan.singles(asked[usable[asked]])
                hashes, doc = scan.span_hashes(of, nth), doc[of]
                one = _distinct(hashes, doc)
                parts.append((hashes[one], doc[one]))
    if not parts:
        return EMPTY
    hashes, docs = (np.concatenate(x) for x in zip(*parts))
    return Entries.of(hashes, np.ones(len(hashes), np.int64), docs)


def _sharded(batch: int, entries: Entries, shards: int) -> pa.Table:
    # by the low bits: samples are chosen by small high bits
    shard = ((entries.hashes & np.uint64(0xFFFFFFFF)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    rows = [(s, batch, *Entries(*[f[order[a:b]] for f in entries.fields()]).packed())
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "batch", "hashes", "counts", "firsts"])


def _first_round(shards: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_batch(batches):
            yield from _sharded(rows[0]["batch"], _entries(rows, [EMPTY] * 3, SAMPLE), shards).to_batches()

    return emit


def _later_round(step: int, shards: int) -> Callable:
    def emit(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not len(texts):
            return _sharded(0, EMPTY, shards)
        rows = texts.to_pylist()
        return _sharded(rows[0]["batch"], _entries(rows, _known(found), step), shards)

    return emit


def _scan_shard(step: int) -> Callable:
    def scan(table: pa.Table) -> pa.Table:
        """Merge a shard's batches level by level; per batch, those of its entries that recur."""
        rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
        family = LevelFamily()
        for row in rows:
            family.add(Entries.unpacked(row["hashes"], row["counts"], row["firsts"]))
        index = family.whole()
        out = []
        for row in rows:
            own = np.frombuffer(row["hashes"], np.uint64)
            _, counts, firsts = index.find(own)
            again = counts > 1
            if again.any():
                out.append((row["batch"], step, *Entries(own[again], counts[again], firsts[again]).packed()))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["batch", "round", "hashes", "counts", "firsts"])

    return scan


def _covered(row: dict, known: list[Entries]) -> list[list[tuple[int, int]]]:
    """Per document of a batch the maximal byte ranges that are covered by spans of earlier documents."""
    ids, has_id, offsets, data = opened(row)
    starts, stops, docs = [], [], []
    for scan in scans(data, offsets):
        settled, asked = _judge(scan, ids, known)
        of, nth = scan.singles(asked)
        hit = known[SINGLE].find(scan.span_hashes(of, nth))[2] < ids[scan.doc[of]]
        of, nth = of[hit], nth[hit]
        settled = np.flatnonzero(settled)
        starts += [scan.start[settled], scan.start[of] + nth]
        stops += [scan.start[settled] + scan.number[settled] + SPAN - 1, scan.start[of] + nth + SPAN]
        docs += [scan.doc[settled], scan.doc[of]]
    out: list[list[tuple[int, int]]] = [[] for _ in ids]
    if docs:
        doc, start, stop = np.concatenate(docs), np.concatenate(starts), np.concatenate(stops)
        order = np.lexsort((start, doc))
        for d, a, b in zip(doc[order].tolist(), start[order].tolist(), stop[order].tolist()):
            if has_id[d]:
                if out[d] and a <= out[d][-1][1]:
                    out[d][-1] = (out[d][-1][0], max(out[d][-1][1], b))
                else:
                    out[d].append((a, b))
    return out


def _cut(texts: pa.Table, found: pa.Table) -> pa.Table:
    known, rows = _known(found), []
    for row in texts.to_pylist():
        ids, has_id, offsets, data = opened(row)
        for i, spans in enumerate(_covered(row, known)):
            text, at, kept = data[offsets[i]:offsets[i + 1]].tobytes(), 0, []
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rows.append((int(ids[i]) if has_id[i] else None, len(text), [{"start": a, "stop": b} for a, b in spans], b"".join(kept)))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
    columns = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "spans", "kept"])


def removed_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): byte ranges that go, and the bytes left, of every document."""
    batches = text_batches(docs, "suffix-batches")
    shards = int((batches.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES) + 1
    found = None
    for step in (SAMPLE, STRETCH, SINGLE):
        if step == SAMPLE:
            entries = batches.mapInArrow(_first_round(shards), ENTRIES)
        else:
            entries = batches.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_later_round(step, shards), ENTRIES)
        new = stage(entries.groupBy("shard").applyInArrow(_scan_shard(step), SHARED), f"suffix-round-{step}")
        found = new if found is None else found.unionAll(new)
    return batches.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_cut, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = removed_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))
