"""Hard negatives of anchors, by secondary sort (operator 13).

An anchor's positives are its best `n_positives` other rows of its label; every positive opens a window of scores, from its own
down to `floor_percent` of it, and takes the first `n_negatives` rows of other labels in that window. Scores are inner products.

Rows are packed into blocks, in the tasks that read them. Blocks of rows meet blocks of anchors, pair by pair, in two rounds: the
first gives each anchor's best rows of its label in the block, which are merged to its positives; the second gives, for each
positive, the first rows of the block inside its window. A block's first rows of a window are all that the whole can take from it,
so nothing is lost, and an anchor has a few rows per block however many rows score alike. These pair scores and the positives are
packed into byte keys of (anchor, descending score, kind, id) and sorted by repartitionAndSortWithinPartitions on the anchor;
one pass over a partition opens a window at a positive and hands each following negative to the open windows, so that an anchor's rows
are never held. Keys of 33 bytes sort as their bytes do: numbers are stored most significant byte first, with the sign turned.

Rows are shuffled once for every group of ANCHORS_PER_GROUP anchors, anchors once for every block of VECTORS_PER_BLOCK rows; a hot
label, a hot vector or a vec_id on many rows does not change what a block holds.

Defined cases: rows with a null id or label, a null or empty vector, or null or non-finite components take no part; shorter vectors count
as padded with zeros; an anchor is a row: rows that share a vec_id are others to each other, and anchors each; equal scores come by vec_id;
a positive with a negative score has an empty window; anchors without positives or negatives give no rows; an empty table gives
no rows; further columns are ignored. Scores beyond bigint wrap.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage

SCALE = 256
N_POSITIVES, N_NEGATIVES, FLOOR_PERCENT = 5, 5, 80
VECTORS_PER_BLOCK = 8192
ANCHORS_PER_GROUP = 2048
ANCHORS_AT_ONCE = 64
BLOCK = "block bigint, ids binary, labels binary, anchors binary, numbers binary, width bigint"
POSITIVE = "anchor bigint, anchor_id bigint, vec_id bigint, score bigint"
#: anchor row, anchor id, descending score, kind (0 positive, 1 negative), vec_id
KEY = ">QQQBQ"
_TOP = 1 << 63


def usable(vectors: Column) -> Column:
    bad = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.isNotNull() & (F.size(vectors) > 0) & ~F.coalesce(bad, F.lit(True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, is anchor, whole numbers) into blocks, each in the order of vec_id."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for a in range(0, len(batch), VECTORS_PER_BLOCK):
            part = batch.slice(a, VECTORS_PER_BLOCK)
            ids = part.column(0).to_numpy()
            vectors = part.column(3)
            sizes = vectors.value_lengths().to_numpy()
            width = int(sizes.max())
            matrix = np.zeros((len(ids), width), np.int64)
            matrix[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
            by = np.argsort(ids, kind="stable")
            yield pa.RecordBatch.from_pydict({
                "block": [number], "ids": [ids[by].tobytes()], "labels": [part.column(1).to_numpy()[by].tobytes()],
                "anchors": [part.column(2).to_numpy(zero_copy_only=False)[by].tobytes()], "numbers": [matrix[by].tobytes()], "width": [width]})
            number += 1


class _Rows:
    """Rows of one block, or of several laid end to end; `row` tells a row from all others."""

    def __init__(self, table: pa.Table):
        parts = [self._of(r) for r in table.to_pylist()]
        width = max(p[4].shape[1] for p in parts)
        self.row, self.ids, self.labels, self.anchor = (np.concatenate([p[k] for p in parts]) for k in range(4))
        self.numbers = np.concatenate([np.pad(p[4], ((0, 0), (0, width - p[4].shape[1]))) for p in parts])
        self.largest = float(np.sqrt((self.numbers.astype(np.float64) ** 2).sum(axis=1).max()))

    @staticmethod
    def _of(r: dict) -> tuple:
        ids = np.frombuffer(r["ids"], np.int64)
        row = (r["block"] << 20) + np.frombuffer(r["rows"], np.int64) if "rows" in r else (r["block"] << 20) + np.arange(len(ids))
        return (row, ids, np.frombuffer(r["labels"], np.int64), np.frombuffer(r["anchors"], bool),
                np.frombuffer(r["numbers"], np.int64).reshape(len(ids), -1))

    def ordered(self) -> _Rows:
        by = np.argsort(self.ids, kind="stable")
        self.row, self.ids, self.labels, self.numbers = self.row[by], self.ids[by], self.labels[by], self.numbers[by]
        return self


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each block, with their places in it."""
    for batch in batches:
        for r in batch.to_pylist():
            at = np.flatnonzero(np.frombuffer(r["anchors"], bool))
            if len(at):
                pick = lambda name, kind: np.frombuffer(r[name], kind)[at].tobytes()
                numbers = np.frombuffer(r["numbers"], np.int64).reshape(-1, r["width"])[at]
                yield pa.RecordBatch.from_pydict({
                    "block": [r["block"]], "ids": [pick("ids", np.int64)], "labels": [pick("labels", np.int64)],
                    "anchors": [pick("anchors", bool)], "numbers": [numbers.tobytes()], "width": [r["width"]],
                    "rows": [at.astype(np.int64).tobytes()], "n": [len(at)]})


def _products(anchors: _Rows, rows: _Rows) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of a few anchors with all rows, exact: in double where every sum is a whole number that a double holds."""
    width = max(anchors.numbers.shape[1], rows.numbers.shape[1])
    q, v = (np.pad(x.numbers, ((0, 0), (0, width - x.numbers.shape[1]))) for x in (anchors, rows))
    exact = anchors.largest * rows.largest < 2**52
    q, v = (q.astype(np.float64), v.astype(np.float64).T.copy()) if exact else (q, v.T)
    for a in range(0, len(q), ANCHORS_AT_ONCE):
        scores = q[a:a + ANCHORS_AT_ONCE] @ v
        for k, line in enumerate(scores.astype(np.int64)):
            yield a + k, line


def _first(scores: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best scores among the places given, which are in the order of vec_id: ties go to the first."""
    if len(among) > n:
        held = scores[among]
        border = np.partition(held, len(held) - n)[len(held) - n]
        above = among[held > border]
        among = np.concatenate([above, among[held == border][:n - len(above)]])
    return among[np.lexsort([among, -scores[among]])]


def _best_of_label(n: int) -> Callable:
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            rows, anchors = _Rows(left).ordered(), _Rows(right)
            places = {label: np.flatnonzero(rows.labels == label) for label in np.unique(anchors.labels)}
            for k, scores in _products(anchors, rows):
                among = places[anchors.labels[k]]
                best = _first(scores, among, n + 1)
                best = best[rows.row[best] != anchors.row[k]][:n]
                out += [(anchors.row[k], anchors.ids[k], rows.ids[p], scores[p]) for p in best]
        columns = np.array(out, np.int64).reshape(-1, 4)
        return pa.table({name: columns[:, k] for k, name in enumerate(("anchor", "anchor_id", "vec_id", "score"))})

    return meet


def _in_windows(n: int, floor_percent: int) -> Callable:
    """Of a block's rows, the first n in each window of each anchor; a row once per anchor."""
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            blocks = right.filter(pc.is_valid(right["ids"]))
            tops = right.filter(pc.is_null(right["ids"]))
            windows: dict[int, set[int]] = {}
            for row, score in zip(tops["anchor"].to_pylist(), tops["score"].to_pylist()):
                windows.setdefault(row, set()).add(score)
            rows, anchors = _Rows(left).ordered(), _Rows(blocks)
            others = {label: np.flatnonzero(rows.labels != label) for label in np.unique(anchors.labels)}
            for k, scores in _products(anchors, rows):
                taken: set[int] = set()
                among = others[anchors.labels[k]]
                held = scores[among]
                for top in windows.get(int(anchors.row[k]), ()):
                    inside = among[(held <= top) & (100 * held >= floor_percent * top)]
                    taken.update(_first(scores, inside, n).tolist())
                out += [(anchors.row[k], anchors.ids[k], rows.ids[p], scores[p]) for p in taken]
        columns = np.array(out, np.int64).reshape(-1, 4)
        return pa.table({name: columns[:, k] for k, name in enumerate(("anchor", "anchor_id", "vec_id", "score"))})

    return meet


def _key(row, kind: int) -> bytes:
    return struct.pack(KEY, row["anchor"] + _TOP, row["anchor_id"] + _TOP, _TOP - 1 - row["score"], kind, row["vec_id"] + _TOP)


def _part(key: bytes) -> int:
    return zlib.crc32(key[:8])


def _windows(n: int, floor_percent: int) -> Callable:
    """Streams sorted keys: a positive opens a window, a negative goes to all open windows that it falls in."""
    def run(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple[int, int, int, int, int, int]]:
        anchor, open_ = None, []
        for key, _ in keys:
            row, anchor_id, falling, kind, vec_id = struct.unpack(KEY, key)
            if row != anchor:
                anchor, open_ = row, []
            score, vec_id = _TOP - 1 - falling, vec_id - _TOP
            if kind == 0:
                open_.append([vec_id, score, 0])
                continue
            open_ = [w for w in open_ if w[2] < n and 100 * score >= floor_percent * w[1]]  # scores only fall: what is closed stays so
            for window in open_:
                window[2] += 1
                yield anchor_id - _TOP, window[0], window[2], vec_id, window[1], score

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, n_positives: int = N_POSITIVES,
                   n_negatives: int = N_NEGATIVES, floor_percent: int = FLOOR_PERCENT, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    label = vectors["label"] if label is None else label
    kept = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
                          F.coalesce(is_anchor, F.lit(False)).alias("anchor"), vectors["embedding"].alias("embedding"))
    kept = kept.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    whole = kept.select("vec_id", "label", "anchor", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    blocks = stage(whole.mapInArrow(_pack, BLOCK), "negative-blocks")
    asked = stage(blocks.mapInArrow(_anchors_of, BLOCK + ", rows binary, n bigint"), "negative-anchors")
    n_blocks, n_anchors = blocks.count(), asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cells, groups = max(1, n_blocks), max(1, -(-n_anchors // ANCHORS_PER_GROUP))

    def every(count: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    # every block meets every group of anchors once: in the cell of both
    left = blocks.select(F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int").alias("cell"), every(groups, "group"), *blocks.columns)
    grouped = asked.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"), *asked.columns)
    right = grouped.select(every(cells, "cell"), *grouped.columns)
    near = left.groupBy("cell", "group").cogroup(right.groupBy("cell", "group")).applyInArrow(_best_of_label(n_positives), POSITIVE)
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "vec_id")
    best = near.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= n_positives).drop("_nth")
    positives = stage(best, "negative-positives")

    # the scores that open windows travel with the anchors' group; an anchor's block is its row's upper part
    tops = positives.select(F.pmod(F.xxhash64(F.shiftright("anchor", 20)), F.lit(groups)).cast("int").alias("group"), "anchor", "score").distinct()
    with_tops = grouped.unionByName(tops, allowMissingColumns=True)
    right = with_tops.select(every(cells, "cell"), *with_tops.columns)
    negatives = left.groupBy("cell", "group").cogroup(right.groupBy("cell", "group")).applyInArrow(_in_windows(n_negatives, floor_percent), POSITIVE)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = positives.rdd.map(lambda r: (_key(r, 0), None)).union(negatives.rdd.map(lambda r: (_key(r, 1), None)))
    found = keys.repartitionAndSortWithinPartitions(parts, _part).mapPartitions(_windows(n_negatives, floor_percent))
    return spark.createDataFrame(found, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.when(vectors["vec_id"] % 7 == 0, (vectors["label"] + 1) % 10).otherwise(vectors["label"])
    return hard_negatives(vectors, vectors["vec_id"] % 100 == 0, label)


SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, e.vec_id, e.r AS other, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score
  FROM e AS a JOIN e ON e.r <> a.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= {N_POSITIVES}),
m AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND {FLOOR_PERCENT} * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= {N_NEGATIVES}"""
