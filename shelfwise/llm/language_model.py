"""Language-model scores by logistic mixing of context bit predictors (operator 5).

The text, lower-cased, is predicted bit by bit, ended by a byte that no text has. Six predictors look at the last one to five
bytes and at the word so far (its last five bytes); each keeps counts of zeros and ones per context and bit. Their stretched
probabilities are mixed with weights chosen by a gate (bit position, longest context seen, word seen); the mix is refined by an
adaptive probability map. Weights and map are learned online, example by example in small steps, with each example's own count left
out of the predictors.

What an event (a byte with the five before it) needs is a function of these six bytes, so Spark works on distinct six-byte strings.
Text batches emit theirs with their training counts; shards by the hash of the last three context bytes add them up. A shard
holds every string of its contexts, hence all counts of orders three to five and of words so far from three bytes on. Orders one and
two and shorter words so far are counts by at most three bytes, whatever the corpus (fewer than 2^25 numbers); they are added up and
broadcast. No count is dropped or approximated, and the sharded table grows with the corpus. Each shard learns weights on its totals;
their average by what each has seen is added up in Spark, of which one set reaches the driver. Shards then compute the probability of
every distinct string once and send it (single precision) back to the batches that hold the string.

A string of one hot context is one entry however often it occurs, so copies and frequent words add no rows to a shard.

Base score: add-0.1 unigram of the words and an end token. Words are compared by 64-bit fingerprints.

Defined cases: a null text is empty and scores its end alone; a null doc_id counts as the text '' for the split; rows that share a
doc_id are scored each on its own, and each counts in training; without training documents the predictors know nothing; an empty
table gives no rows; further columns are ignored; long texts are read in pieces, with the bytes before each piece.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage
from shelfwise.llm.batches import by_batch, opened, text_batches
from shelfwise.llm.shingles import GAP, LOWER, mix64, word_hashes

HELD_OUT = 10
SMOOTH = 0.1
ORDERS = 5
INPUTS = ORDERS + 1
#: Contexts of fewer bytes are counted for all shards together.
LOCAL = 3
END_BYTE = 0xFF
CHUNK = 1 << 19
SHARD_BYTES = 8 << 20
EVENTS_AT_ONCE = 1 << 16
GATES = 8 * (ORDERS + 1) * 2
STEPS, MAP_CELLS = 1024, 33
RATE, MAP_RATE, PRIOR = 0.5, 0.02, 0.4
WORD, GRAM = 0, 1
CODEC = "zstd"
U = np.uint64

ENTRIES = "kind int, shard int, batch bigint, codes binary, counts binary"
SHORT = "key bigint, n bigint"
LEARNED = "cell int, weighted double, seen double"
BACK = "kind int, batch bigint, codes binary, results binary"
RESULT = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, "
          "n_bytes bigint")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == 0


# Events and contexts

def _parts(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int, bool]]]:
    """Groups of (document, from, to, ends here); long documents are cut."""
    held, size = [], 0
    for doc, length in enumerate(np.diff(offsets).tolist()):
        for a in range(0, max(length, 1), CHUNK):
            b = min(a + CHUNK, length)
            held.append((doc, a, b, b == length))
            size += b - a
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _turned(code: np.ndarray) -> np.ndarray:
    """The code of a six-byte string: the three bytes before the last one, the two before these, the last. Strings of a shard share
    their upper bytes then and pack small."""
    return ((code >> U(8) & U(0xFFFFFF)) << U(24)) | (code >> U(32) << U(8)) | (code & U(0xFF))


def _straight(code: np.ndarray) -> np.ndarray:
    """The six bytes of a code in the order of the text."""
    return ((code >> U(8) & U(0xFFFF)) << U(32)) | (code >> U(24) << U(8)) | (code & U(0xFF))


def events(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, code) of all byte events of all texts, the end of a text included."""
    start, end = np.zeros(ORDERS, np.uint8), np.array([END_BYTE], np.uint8)
    for parts in _parts(offsets):
        pieces, skip, take = [], [], []
        for doc, a, b, ends in parts:
            back = min(a, ORDERS)
            pieces += [start, data[offsets[doc] + a - back:offsets[doc] + b]] + ([end] if ends else [])
            skip.append(ORDERS + back)
            take.append(b - a + ends)
        chunk = LOWER[np.concatenate(pieces)]
        skip, take = np.array(skip), np.array(take)
        first = np.cumsum(skip + take) - take
        at = np.arange(take.sum()) + np.repeat(first - (np.cumsum(take) - take), take)
        code = np.zeros(len(chunk), U)
        for back in range(ORDERS, -1, -1):
            code[back:] |= chunk[:len(chunk) - back].astype(U) << U(8 * back)
        yield np.repeat(np.array([p[0] for p in parts]), take), _turned(code[at])


def context_keys(code: np.ndarray) -> np.ndarray:
    """Context and next byte of each predictor as one number, a row a predictor: its kind, the context bytes, the byte."""
    code = _straight(code)
    rows = [(code & U((1 << 8 * (k + 1)) - 1)) | U(k << 56) for k in range(1, ORDERS + 1)]
    length, open_ = np.zeros(len(code), U), np.ones(len(code), bool)
    for k in range(1, ORDERS + 1):
        byte = ((code >> U(8 * k)) & U(0xFF)).astype(np.uint8)
        open_ &= ~(GAP[byte] | (byte == 0))
        length += open_
    rows.append((code & ((U(1) << (U(8) * (length + U(1)))) - U(1))) | ((length + U(INPUTS)) << U(56)))
    return np.stack(rows)


def _is_short(keys: np.ndarray) -> np.ndarray:
    """Whether the context of a key has fewer than LOCAL bytes."""
    kind = (keys >> U(56)).astype(np.int64)
    return np.where(kind <= ORDERS, kind, kind - INPUTS) < LOCAL


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and their total counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts[order], heads)


def _key_counts(code: np.ndarray, counts: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of distinct events, those of short contexts or the others, with their counts."""
    keys = context_keys(code).ravel()
    wanted = _is_short(keys) == short
    return _counted(keys[wanted], np.tile(counts, INPUTS)[wanted])


@dataclass
class Predictors:
    """Counts of all keys of some events. `paths[p]` holds, for each key, how often its context was followed by a byte with the
    first p bits of the key's byte: the difference of two rows gives the zeros and ones of a bit."""
    keys: np.ndarray
    paths: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Predictors:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        paths = np.zeros((9, len(keys)))
        for p in range(9):
            group = keys >> U(8 - p)
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(keys) else np.zeros(0, np.int64)
            if len(heads):
                paths[p] = np.repeat(np.add.reduceat(counts, heads), np.diff(np.append(heads, len(keys))))
        return cls(keys, paths)

    def places(self, code: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, context_keys(code))


@dataclass
class Mixer:
    weights: np.ndarray
    cells: np.ndarray

    @classmethod
    def fresh(cls) -> Mixer:
        """Weights and map before learning."""
        centre = np.linspace(-11, 11, MAP_CELLS)
        return cls(np.full((GATES, INPUTS), 0.3), np.tile(1 / (1 + np.exp(-centre)), (GATES, 1)))

    @staticmethod
    def gate(position: int, seen: np.ndarray) -> np.ndarray:
        longest = np.max(seen[:ORDERS] * np.arange(1, ORDERS + 1)[:, None], axis=0)
        return (position * (ORDERS + 1) + longest) * 2 + seen[ORDERS]

    def bits(self, predictors: Predictors, code: np.ndarray, counts: np.ndarray | None = None, tally: list | None = None) -> np.ndarray:
        """log2 probability of each event. With `counts`, learn from the events, one step per bit position."""
        learn = counts is not None
        total, at, byte = np.zeros(len(code)), predictors.places(code), (code & U(0xFF)).astype(np.int64)
        reached = predictors.paths[0][at] - learn
        for position in range(8):
            bit = (byte >> (7 - position)) & 1
            same = predictors.paths[position + 1][at] - learn
            stretched = np.log((same + PRIOR) / (reached - same + PRIOR)) * (2 * bit - 1)
            gate = self.gate(position, reached > 0)
            z = np.einsum("kn,nk->n", stretched, self.weights[gate]).clip(-11, 11)
            mixed = 1 / (1 + np.exp(-z))
            cell = np.rint((z + 11) * (MAP_CELLS - 1) / 22).astype(np.int64)
            p = ((mixed + self.cells[gate, cell]) / 2).clip(2.0**-16, 1 - 2.0**-16)
            total += np.log2(np.where(bit == 1, p, 1 - p))
            if learn:
                self._learn(gate, cell, bit, counts, stretched, mixed, tally)
            reached = same
        return total

    def _learn(self, gate, cell, bit, counts, stretched, mixed, tally) -> None:
        weight = np.bincount(gate, counts, GATES)
        scale = counts * (bit - mixed)
        for k in range(INPUTS):
            step = np.bincount(gate, scale * stretched[k], GATES)
            self.weights[:, k] += RATE * step / np.maximum(weight, 1e-9) * (weight > 0)
        flat = gate * MAP_CELLS + cell
        size = np.bincount(flat, counts, GATES * MAP_CELLS).reshape(GATES, MAP_CELLS)
        ones = np.bincount(flat, counts * bit, GATES * MAP_CELLS).reshape(GATES, MAP_CELLS)
        rate = np.minimum(MAP_RATE * np.log1p(size), 0.5)
        self.cells += rate * (np.divide(ones, size, out=self.cells.copy(), where=size > 0) - self.cells)
        tally[0] += weight
        tally[1] += size


# Rows between tasks

def _packed(codes: np.ndarray) -> bytes:
    """Sorted numbers as gaps, byte plane by byte plane: the upper planes are nearly empty and shrink."""
    gaps = np.diff(codes, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return U(len(codes)).tobytes() + pa.compress(gaps, codec=CODEC, asbytes=True) if len(codes) else b""


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    n = int(np.frombuffer(data, U, 1)[0])
    gaps = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec=CODEC, asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(gaps.reshape(8, -1).T).view(U).ravel(), dtype=U)


def _counts_packed(counts: np.ndarray) -> bytes:
    """Counts as one byte each, those from 255 on listed behind."""
    return U(len(counts)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _counts_unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, U, 1)[0])
    counts = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[8 + n:], np.int64)
    return counts


def _logs_packed(logs: np.ndarray) -> bytes:
    """Single-precision numbers, byte plane by byte plane: signs and exponents repeat."""
    return pa.compress(np.ascontiguousarray(logs.view(np.uint8).reshape(-1, 4).T).tobytes(), codec=CODEC, asbytes=True)


def _logs_unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec=CODEC, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.float32).ravel()


def _record(rows: list[tuple], text: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in text.split(", "))])
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for many in batches:
        for i in range(len(many)):
            yield many.slice(i, 1).to_pylist()[0]


# Counting: what batches emit and what shards add up

def _shard_rows(kind: int, batch: int, codes: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple]:
    spread = codes if kind == WORD else mix64(codes >> U(8 * LOCAL))
    shard = ((spread >> U(40)) * U(shards) >> U(24)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    owned = ((s, order[cuts[s]:cuts[s + 1]]) for s in range(shards))
    return [(kind, s, batch, _packed(codes[own]), _counts_packed(counts[own])) for s, own in owned if len(own)]


def _counter(shards: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_batch(batches):
            # the last bit tells training events from the others
            marked, hashed = [], []
            for ids, known, offsets, data in map(opened, rows):
                train = np.array([not held_out(x if k else None) for x, k in zip(ids.tolist(), known.tolist())], bool)
                hashes, doc = word_hashes(data, offsets)
                hashed.append(_counted(hashes, train[doc].astype(np.int64) if len(doc) else np.zeros(0, np.int64)))
                marked += [code << U(1) | train[doc] for doc, code in events(data, offsets)]
            every = np.concatenate(marked)
            marked.clear()
            every.sort()
            codes = every >> U(1)
            heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            counts = np.add.reduceat((every & U(1)).astype(np.int64), heads)
            batch = rows[0]["batch"]
            words = _counted(*[np.concatenate(x) for x in zip(*hashed)])
            yield _record(_shard_rows(WORD, batch, *words, shards) + _shard_rows(GRAM, batch, codes[heads], counts, shards), ENTRIES)

    return count


def _total(table: pa.Table) -> pa.Table:
    """Add up a shard. A row without a batch holds its totals (of words: tokens and types); with it, for words, every batch gets the
    totals of its own words back, for strings, it keeps which ones a batch asks for."""
    rows = table.to_pylist()
    kind, shard = rows[0]["kind"], rows[0]["shard"]
    codes = [_unpacked(r["codes"]) for r in rows]
    distinct, totals = _counted(np.concatenate(codes), np.concatenate([_counts_unpacked(r["counts"]) for r in rows]))
    if kind == GRAM:
        out = [(kind, shard, None, _packed(distinct), _counts_packed(totals))] + [(kind, shard, r["batch"], r["codes"], b"") for r in rows]
    else:
        out = [(kind, shard, None, b"", np.array([totals.sum(), (totals > 0).sum()], np.int64).tobytes())]
        out += [(kind, shard, r["batch"], r["codes"], _counts_packed(totals[np.searchsorted(distinct, own)])) for r, own in zip(rows, codes)]
    return pa.Table.from_batches([_record(out, ENTRIES)])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        keys, counts = _key_counts(_unpacked(row["codes"]), _counts_unpacked(row["counts"]), True)
        yield pa.RecordBatch.from_pydict({"key": keys.astype(np.int64), "n": counts})


def _predictors(codes: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray]) -> Predictors:
    keys, n = _key_counts(codes, counts, False)
    return Predictors.of(np.concatenate([short[0], keys]), np.concatenate([short[1], n]))


def _learner(shared) -> Callable:
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            codes, counts = _unpacked(row["codes"]), _counts_unpacked(row["counts"])
            predictors = _predictors(codes, counts, shared.value)
            mixer, tally = Mixer.fresh(), [np.zeros(GATES), np.zeros((GATES, MAP_CELLS))]
            order = np.random.default_rng(5).permutation(np.flatnonzero(counts))
            for a in range(0, len(order), STEPS):
                step = order[a:a + STEPS]
                mixer.bits(predictors, codes[step], counts[step].astype(np.float64), tally)
            seen = np.concatenate([np.repeat(tally[0], INPUTS), tally[1].ravel()])
            values = np.concatenate([mixer.weights.ravel(), mixer.cells.ravel()])
            yield pa.RecordBatch.from_pydict({"cell": np.arange(len(seen), dtype=np.int32), "weighted": values * seen, "seen": seen})

    return learn


def averaged(learned: DataFrame) -> Mixer:
    """Weights and map of all shards, each by the events it saw; sums are exact, so that their order does not matter."""
    exact = lambda name: F.sum(F.col(name).cast("decimal(28,8)")).cast("double").alias(name)
    mixer = Mixer.fresh()
    values = np.concatenate([mixer.weights.ravel(), mixer.cells.ravel()])
    for row in learned.groupBy("cell").agg(exact("weighted"), exact("seen")).collect():
        if row["seen"] > 0:
            values[row["cell"]] = row["weighted"] / row["seen"]
    return Mixer(values[:GATES * INPUTS].reshape(GATES, INPUTS), values[GATES * INPUTS:].reshape(GATES, MAP_CELLS))


# Scores

def _evaluator(shared) -> Callable:
    def evaluate(table: pa.Table) -> pa.Table:
        """log2 probabilities of the strings of a shard, for each batch that holds them."""
        short, mixer = shared.value
        rows = table.to_pylist()
        total = next(r for r in rows if r["batch"] is None)
        codes, counts = _unpacked(total["codes"]), _counts_unpacked(total["counts"])
        predictors = _predictors(codes, counts, short)
        pieces = [codes[a:a + EVENTS_AT_ONCE] for a in range(0, len(codes), EVENTS_AT_ONCE)]
        bits = np.concatenate([mixer.bits(predictors, piece) for piece in pieces]).astype(np.float32)
        out = [(GRAM, r["batch"], r["codes"], _logs_packed(bits[np.searchsorted(codes, _unpacked(r["codes"]))])) for r in rows if r is not total]
        return pa.Table.from_batches([_record(out, BACK)])

    return evaluate


def _looked_up(rows: list[dict], kind: int, read: Callable, dtype) -> tuple[np.ndarray, np.ndarray]:
    own = [r for r in rows if r["kind"] == kind]
    held = [_unpacked(r["codes"]) for r in own]
    codes = np.concatenate([np.zeros(0, U), *held])
    values = np.concatenate([np.zeros(0, dtype), *[read(r["results"], len(c)) for r, c in zip(own, held)]])
    order = np.argsort(codes)
    return codes[order], values[order]


def _scorer(n_tokens: int, n_types: int, n_ends: int) -> Callable:
    def score(texts: pa.Table, back: pa.Table) -> pa.Table:
        found = back.to_pylist()
        hashes, totals = _looked_up(found, WORD, lambda data, n: _counts_unpacked(data), np.int64)
        codes, logs = _looked_up(found, GRAM, _logs_unpacked, np.float32)
        space, rows = n_tokens + SMOOTH * (n_types + 1), []
        for row in texts.to_pylist():
            ids, known, offsets, data = opened(row)
            own, doc = word_hashes(data, offsets)
            c = totals[np.searchsorted(hashes, own)] if len(own) else np.zeros(0, np.int64)
            base = np.bincount(doc, np.log10((c + SMOOTH) / space), len(ids)) + np.log10((n_ends + SMOOTH) / space)
            n, n_known = np.bincount(doc, minlength=len(ids)) + 1, np.bincount(doc, c > 0, len(ids)).astype(np.int64) + (n_ends > 0)
            bits = np.zeros(len(ids))
            for doc, code in events(data, offsets):
                bits += np.bincount(doc, logs[np.searchsorted(codes, code)], len(ids))
            for i in range(len(ids)):
                doc_id = int(ids[i]) if known[i] else None
                rows.append((doc_id, held_out(doc_id), int(n[i]), int(n_known[i]), n_tokens, float(base[i]), float(bits[i] * np.log10(2)),
                             int(offsets[i + 1] - offsets[i])))
        return pa.Table.from_batches([_record(rows, RESULT)])

    return score


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        n, types = np.frombuffer(row["counts"], np.int64).tolist()
        yield pa.RecordBatch.from_pydict({"n": [n], "types": [types]})


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of every document."""
    spark = docs.sparkSession
    batches = text_batches(docs, "lm-batches")
    train = F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(0)) % HELD_OUT != 0
    n_ends = docs.filter(train).count()
    shards = int((batches.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES) + 1
    added = stage(batches.mapInArrow(_counter(shards), ENTRIES).groupBy("kind", "shard").applyInArrow(_total, ENTRIES), "lm-counts")
    totals = added.filter("batch is null")
    tokens = totals.filter(f"kind = {WORD}").mapInArrow(_sizes, "n bigint, types bigint").agg(F.sum("n"), F.sum("types")).first()
    n_words, n_types = (x or 0 for x in tokens)
    strings = totals.filter(f"kind = {GRAM}").repartition(shards)
    # one row per string of at most three bytes and kind: a table whose size the alphabet bounds
    table = strings.mapInArrow(_short, SHORT).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    short = table["key"].to_numpy().astype(U), table["n"].to_numpy()
    mixer = averaged(stage(strings.mapInArrow(_learner(spark.sparkContext.broadcast(short)), LEARNED), "lm-weights"))
    shared = spark.sparkContext.broadcast((short, mixer))
    logs = added.filter(f"kind = {GRAM}").groupBy("shard").applyInArrow(_evaluator(shared), BACK)
    words = added.filter(f"kind = {WORD} and batch is not null").select("kind", "batch", "codes", F.col("counts").alias("results"))
    run = _scorer(n_words + n_ends, n_types + (n_ends > 0), n_ends)
    return batches.groupBy("batch").cogroup(logs.union(words).groupBy("batch")).applyInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
