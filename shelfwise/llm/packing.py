"""Best-fit packing of token sequences, planned on the histogram of lengths (operator 9).

A document is its ids and an end id. Documents longer than a sequence are cut into pieces of full length; what is over stands
first. Pieces are then counted by length, and best-fit decreasing is run over these counts, at most one per length: sequences of
equal fill are one group with a multiplicity, so a step moves whole groups. The plan says which ranks within a length go to which
sequences; pieces find their slot by joining on length and rank. Only the histogram reaches the driver, never a document.

The plan is broadcast: it has one row per length and group that takes it, at most (sequence length)^2 / 2 rows whatever the corpus.

Defined cases: a null text is empty and packs its end id alone; rows that share a doc_id, or have none, are documents of their own;
an empty table gives no rows; further columns are ignored.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.ordering import running_totals
from shelfwise.functions.staging import stage
from shelfwise.llm.shingles import pieces as slices
from shelfwise.llm.text import whole
from shelfwise.llm.tokens import encoded

LENGTH = 1024
END = 2
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLAN = "length bigint, first bigint, last bigint, per_sequence bigint, sequence bigint, place bigint"


def _cutter(path: str, length: int, with_ids: bool) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for every in batches for piece in slices(every)):
            ids, begins = encoded(batch.column(1), path)
            rows: list[tuple] = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), begins[:-1].tolist(), begins[1:].tolist()):
                own = np.append(ids[a:b], END).astype("<u4")
                stop = (len(own) - 1) % length + 1
                start = number = 0
                while start < len(own):
                    data = own[start:stop].tobytes()
                    rows.append((doc_id, number, start, stop - start, zlib.crc32(data), data))
                    start, stop, number = stop, stop + length, number + 1
            columns = list(zip(*rows))[: 6 if with_ids else 5]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[:len(columns)])

    return cut


def token_pieces(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, ids as little-endian 32-bit numbers."""
    return docs.select("doc_id", whole().alias("text")).mapInArrow(
        _cutter(path, length, with_ids), PIECES + (", ids binary" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: rows of PLAN. Ranks count from 0 over all pieces, longest first."""
    rooms: list[int] = []  # distinct free amounts, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # free amount -> (first sequence, number of sequences)
    rows, opened, rank = [], 0, 0

    def put(free: int, begin: int, number: int) -> None:
        if free and number:
            if free not in groups:
                insort(rooms, free)
                groups[free] = []
            groups[free].append((begin, number))

    def fill(size: int, left: int, free: int, begin: int, number: int) -> int:
        """Fill sequences of one group to the brim, the last one with what is left; how many pieces they took."""
        nonlocal rank
        each = free // size
        full = min(number, left // each)
        if full:
            rows.append((size, rank, rank + full * each, each, begin, capacity - free))
            put(free - each * size, begin, full)
            rank += full * each
        rest = left - full * each
        if full == number or not rest:
            put(free if full < number else 0, begin + full, number - full)
            return full * each
        rows.append((size, rank, rank + rest, rest, begin + full, capacity - free))
        put(free - rest * size, begin + full, 1)
        put(free if free < capacity else 0, begin + full + 1, number - full - 1)
        rank += rest
        return left

    for size in sorted(counts, reverse=True):
        left = counts[size]
        fitting = rooms[bisect_left(rooms, size):]
        for free in fitting:
            if not left:
                break
            held = groups.pop(free)
            rooms.remove(free)
            for begin, number in held:
                if left:
                    left -= fill(size, left, free, begin, number)
                else:
                    put(free, begin, number)
        if left:
            number = -(-left // (capacity // size))
            fill(size, left, capacity, opened, number)
            opened += number
    return rows


def placed(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """Pieces with sequence_id and offset. `pieces` is read twice and should be a written table."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = pieces.sparkSession.createDataFrame(plan(counts, capacity), PLAN)
    order = [F.col("length").desc(), F.col("doc_id").asc(), F.col("piece").asc()]
    ranked = running_totals(pieces, order, {"_rank": F.lit(1).cast("bigint")}, "pack-order").withColumn("_at", F.col("_rank") - 1)
    slots = F.broadcast(rows.withColumnRenamed("length", "_length"))
    joined = ranked.join(slots, (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("first")) & (F.col("_at") < F.col("last")))
    nth = F.col("_at") - F.col("first")
    return joined.select(*pieces.columns, (F.col("sequence") + F.floor(nth / F.col("per_sequence"))).alias("sequence_id"),
                         (F.col("place") + nth % F.col("per_sequence") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents with their place: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    return placed(stage(token_pieces(docs, path, length, with_ids), "pack-pieces"), length)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the ids of a sequence one after the other. `packed` has ids; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("_p"))
    ids = F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return joined.select("sequence_id", ids.alias("ids"), F.transform("_p", lambda p: p["doc_id"]).alias("doc_ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
