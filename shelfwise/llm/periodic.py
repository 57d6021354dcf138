"""Runs: stretches of consecutive words that repeat with a period, found by descending-LCP Kruskal (operator 11).

Per text, suffixes of the word sequence are put in order and neighbours in that order are edges whose weight is their longest
common prefix (LCP). Edges are taken by decreasing LCP; union-find unites the classes of suffixes, the smaller ordered set of
positions into the larger. At level l the class of a position holds exactly the positions whose next l words are the same. Two
positions that become neighbours in an ordered set at level l, at distance d, seed a run of period d that starts at the first
of them, if l + d is long enough and the word before differs from the word d later (else the run starts earlier and has its own
seed). A nearer position in between would give a shorter period, so d is the smallest period; a pair counts only if it is still
neighbouring when all edges of its level are in. Every run of two periods or more is seeded once, by its first position.

Only runs of `min_length` words and `min_exponent` periods are asked for, so LCPs below `_least_lcp` need no edge: positions whose
next words (that many) stand once in their text are left out by hash before anything is sorted, and texts without others cost a
sort of hashes alone. Suffixes of the rest are ordered by prefix doubling, many texts at once in numpy; the ranks of all rounds
give the LCPs. That takes 4 bytes a word and round, and rounds grow with the logarithm of the longest repeat.

A text is one task's work, texts are not shuffled. Words are compared by their bytes; no normalisation.

Defined cases: a null, empty or blank text has no words and no runs; rows that share a doc_id are separate; a row without a doc_id
keeps its null; equal rows give equal results; an empty table gives no rows; further columns are ignored.
"""
from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.shingles import mix64, pieces
from shelfwise.llm.text import bind, whole, words

MIN_LENGTH, MIN_EXPONENT = 6, 4
FOUND = "doc_id {id}, n_words bigint, runs array<struct<start:bigint,period:bigint,length:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _needed(period: int, min_length: int, min_exponent: float) -> int:
    """Least length of a run of this period."""
    return max(min_length, 2 * period, ceil(Fraction(min_exponent) * period))


def _least_lcp(min_length: int, min_exponent: float) -> int:
    """Least LCP of the first position of a run with the one a period later; it does not fall beyond period `min_length`."""
    return max(1, min(_needed(q, min_length, min_exponent) - q for q in range(1, max(min_length, 1) + 1)))


def _repeated(codes: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Whether the next `width` words of a position, hashed with its text's number, stand elsewhere too; may be too often true."""
    n = len(codes) - width + 1
    out = np.zeros(len(codes), bool)
    if n <= 0:
        return out
    hashed = mix64(text[:n].astype(np.uint64) + np.uint64(1))
    for k in range(width):
        hashed = (hashed ^ mix64(codes[k:k + n].astype(np.uint64) + np.uint64(2))) * _STEP
        hashed ^= hashed >> np.uint64(29)
    ordered = np.sort(hashed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        at = np.minimum(np.searchsorted(twice, hashed), len(twice) - 1)
        out[:n] = twice[at] == hashed
    return out


def _ranked(same_as_before: np.ndarray) -> np.ndarray:
    """For sorted items: the place of the first of the equal ones."""
    place = np.arange(len(same_as_before))
    return np.maximum.accumulate(np.where(same_as_before, 0, place))


def _edges(codes: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, lcp): neighbours in suffix order with an LCP of at least `width`. `codes` has a 0 after each text's words, none else."""
    n = len(codes)
    columns = [np.concatenate([codes[k:], np.zeros(k, codes.dtype)]) for k in range(width)]
    order = np.lexsort([*columns[::-1], text])
    equal = np.zeros(n, bool)
    equal[1:] = text[order[1:]] == text[order[:-1]]
    for column in columns:
        equal[1:] &= column[order[1:]] == column[order[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = _ranked(equal)
    held, length = [(width, rank)], width
    grouped = equal.copy()
    grouped[:-1] |= equal[1:]
    places = np.flatnonzero(grouped)  # places of the order whose suffix is not told apart yet
    first = np.flatnonzero(equal)
    while len(places):
        suffixes = order[places]
        group, then = rank[suffixes], rank[np.minimum(suffixes + length, n - 1)]
        by = np.lexsort([then, group])
        order[places] = suffixes[by]
        group, then = group[by], then[by]
        same = np.zeros(len(places), bool)
        same[1:] = (group[1:] == group[:-1]) & (then[1:] == then[:-1])
        rank = rank.copy()
        rank[order[places]] = places[_ranked(same)]
        length *= 2
        held.append((length, rank))
        more = same.copy()
        more[:-1] |= same[1:]
        places = places[more]
    a, b = order[first - 1], order[first]
    lcp = np.zeros(len(a), np.int64)
    for length, rank in reversed(held):
        x, y = a + lcp, b + lcp
        inside = (x < n) & (y < n)
        lcp += length * (inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]))
    going = np.ones(len(a), bool)
    for _ in range(width - 1):
        x, y = a + lcp, b + lcp
        going &= (x < n) & (y < n)
        going &= codes[np.minimum(x, n - 1)] == codes[np.minimum(y, n - 1)]
        lcp += going
    return a, b, lcp


def _kruskal(codes: list[int], edges: tuple[np.ndarray, np.ndarray, np.ndarray], min_length: int, min_exponent: float) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs, from edges by decreasing LCP."""
    a, b, lcp = edges
    by = np.argsort(-lcp, kind="stable")
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[:len(a)][by].tolist(), inverse[len(a):][by].tolist()
    levels = lcp[by].tolist()
    members: list[list[int]] = [[p] for p in nodes.tolist()]
    parent = list(range(len(members)))
    runs, pending = [], []
    # a pair at distance d needs l + d >= min_exponent * d, so l * den >= d * num
    over = max(Fraction(min_exponent), Fraction(2)) - 1
    num, den = over.numerator, over.denominator

    def settle(level: int) -> None:
        for p, s, node in pending:
            while parent[node] != node:
                node = parent[node]
            held = members[node]
            at = bisect_left(held, p) + 1
            if held[at] == s:
                runs.append((p, s - p, level + s - p))
        pending.clear()

    level = levels[0] if levels else 0
    for x, y, l in zip(left, right, levels):
        if l != level:
            if pending:
                settle(level)
            level = l
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        big, small = members[x], members[y]
        if len(big) < len(small):
            x, y, big, small = y, x, small, big
        parent[y] = x
        before = -1
        for p in small:
            at = bisect_left(big, p)
            if at and big[at - 1] != before:  # those of the smaller set have met already
                q = big[at - 1]
                d = p - q
                if d * num <= l * den and l + d >= min_length and codes[q - 1] != codes[p - 1]:
                    pending.append((q, p, x))
            if at < len(big):
                q = big[at]
                d = q - p
                if d * num <= l * den and l + d >= min_length and codes[p - 1] != codes[q - 1]:
                    pending.append((p, q, x))
                insort(big, p)
            else:
                big.append(p)
            before = p
        members[y] = ()
    if pending:
        settle(level)
    return runs


def runs_of(codes: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> np.ndarray:
    """Rows (text, start, period, length), by text, start and period, of all runs in word sequences laid end to end.

    `codes` are numbers from 1 that are equal for equal words, `offsets` where each text begins, with the end of the last.
    """
    width = _least_lcp(min_length, min_exponent)
    sizes = np.diff(offsets)
    texts = np.arange(len(sizes))
    # a 0 after every text, and one before the first, so that no prefix reaches into another text
    spread = np.zeros(len(codes) + len(sizes) + 1, np.int64)
    begin = offsets[:-1] + texts + 1
    spread[np.arange(len(codes)) + np.repeat(texts, sizes) + 1] = codes
    of = np.concatenate([[0], np.repeat(texts, sizes + 1)]) if len(sizes) else np.zeros(1, np.int64)
    again = np.unique(of[_repeated(spread, of, width)])
    if not len(again):
        return np.zeros((0, 4), np.int64)
    taken = np.zeros(len(sizes), bool)
    taken[again] = True
    use = np.concatenate([[True], np.repeat(taken, sizes + 1)])
    part, part_of, at = spread[use], of[use], np.flatnonzero(use)
    found = _kruskal(part.tolist(), _edges(part, part_of, width), min_length, min_exponent)
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.array(found, np.int64)
    start = at[rows[:, 0]]
    out = np.column_stack([of[start], start - begin[of[start]], rows[:, 1], rows[:, 2]])
    return out[np.lexsort([out[:, 2], out[:, 1], out[:, 0]])]


def _judge(min_length: int, min_exponent: float) -> Callable:
    def of_piece(piece: pa.RecordBatch) -> pa.RecordBatch:
        split = pc.ascii_split_whitespace(piece.column(1).fill_null("").cast(pa.string()))
        flat, bounds = split.flatten(), np.asarray(split.offsets) - split.offsets[0].as_py()
        filled = np.asarray(pc.greater(pc.binary_length(flat), 0))  # gaps at the ends leave empty words
        flat = flat.filter(pa.array(filled))
        offsets = np.concatenate([[0], np.cumsum(filled)])[bounds]
        sizes = np.diff(offsets)
        codes = np.asarray(flat.dictionary_encode().indices).astype(np.int64) + 1
        runs = runs_of(codes, offsets, min_length, min_exponent)
        # words after the first period of a run go
        step = np.zeros(len(codes) + 1, np.int64)
        begin = offsets[runs[:, 0]] + runs[:, 1]
        np.add.at(step, begin + runs[:, 2], 1)
        np.add.at(step, begin + runs[:, 3], -1)
        stays = np.cumsum(step)[:-1] == 0
        ends = np.concatenate([[0], np.cumsum(stays)])[offsets]
        kept = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(pa.array(stays)))
        per_text = np.concatenate([[0], np.cumsum(np.bincount(runs[:, 0], minlength=len(sizes)))]).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
        return pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(per_text), rows),
             pc.binary_join(kept, " ")], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield of_piece(piece)

    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: runs by start and period (word numbers from 0), and the words left, joined by a
    space, once every run keeps its first period only. `min_exponent` below 2 counts as 2."""
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return texts.mapInArrow(_judge(min_length, min_exponent), FOUND.format(id=texts.schema["doc_id"].dataType.simpleString()))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32 of the id is divisible by 10, the words from a place on repeat with a period, as the contract plants."""
    h = F.crc32(docs["doc_id"].cast("string"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")

    planted_text = bind(words(whole()), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))
    return docs.select(docs["doc_id"].alias("doc_id"), F.when(h % 10 == 0, planted_text).otherwise(docs["text"]).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeated_tails(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    # runs come by start and period, so the first of equal exponents stays
    higher = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,period:bigint,length:bigint>")
    top = F.aggregate("runs", none, lambda best, r: F.when(higher(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), top.alias("_top"),
                        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "_top.start", "_top.length", "_top.period",
                       F.expr("_top.length * 1000 div _top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
