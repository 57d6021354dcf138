"""Exact top-k search by inner product with multi-resolution segment statistics (operator 8).

Vectors are cut into equal segments; of every segment the mean and the deviation are kept, coarse (few segments) and fine. For
two vectors the squared distance is at least L * ((m - m')^2 + (s - s')^2) summed over segments of length L; with the norms, that is
an upper bound of the inner product. A block of queries meets a block of vectors: the best by the coarse bound are scored to
get each query's threshold, pairs whose bound is below it are dropped coarse to fine, and the survivors are scored exactly.
Every query meets every vector, in blocks of fixed size; a block pair gives k rows per query, merged by rank.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an id take no part; rows that
share a vec_id are candidates of each other, and queries each; shorter vectors count as padded with zeros; fewer than k candidates give fewer rows;
an empty table gives no rows; further columns are ignored. Scores beyond bigint wrap.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage

K = 20
SCALE = 64
VECTORS_PER_BLOCK = 16384
QUERIES_PER_BLOCK = 512
QUERIES_AT_ONCE = 64
#: Numbers of segments, coarse to fine; a vector is padded to a multiple of the last.
SEGMENTS = (4, 16)
#: Bounds are single-precision sums; they are widened by this part of the norms.
SLACK = 2e-5
FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def usable(vectors: Column) -> Column:
    bad = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.isNotNull() & ~F.coalesce(bad, F.lit(True))


def scaled(vectors: Column) -> Column:
    """Components x as floor(SCALE * x) in double, then bigint."""
    return F.transform(vectors, lambda x: F.floor(x.cast("double") * SCALE))


def blocks(rows: DataFrame, number: int, label: str) -> DataFrame:
    """(block, ids, rows, numbers, width): the rows (row, vec_id, v) packed into blocks by hash of the row number."""
    def packed(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        ids, row = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "row"))
        vectors = table.column("v").to_pylist()
        order = np.lexsort([row, ids])
        width = max(map(len, vectors))
        width += -width % SEGMENTS[-1]
        matrix = np.zeros((len(ids), width), np.int64)
        for at, i in enumerate(order):
            matrix[at, :len(vectors[i])] = vectors[i]
        return pa.table({"block": [block], "ids": [ids[order].tobytes()], "rows": [row[order].tobytes()], "numbers": [matrix.tobytes()], "width": [width]})

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(number)))
    return stage(keyed.groupBy("block").applyInArrow(packed, "block bigint, ids binary, rows binary, numbers binary, width bigint"), label)


def statistics(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Per vector the means and deviations of its segments, each times the root of the segment length."""
    cut = matrix.reshape(len(matrix), segments, -1)
    root = cut.shape[2] ** 0.5
    return np.hstack([cut.mean(axis=2), cut.std(axis=2)]) * root


def _products(q: np.ndarray, v: np.ndarray, exact_in_double: bool) -> np.ndarray:
    """Exact inner products of all rows: by floating-point products where every sum is a whole number that a double holds."""
    if exact_in_double:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def search(q_rows: np.ndarray, q_ids: np.ndarray, q: np.ndarray, v_rows: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int = K) -> tuple[np.ndarray, ...]:
    """The k best of the block's vectors per query: query rows and ids, vector ids, scores. Ties go to the smaller vec_id."""
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, v))
    size_q, size_v = (np.linalg.norm(m.astype(np.float64), axis=1) for m in (q, v))
    exact_in_double = size_q.max() * size_v.max() < 2**52
    slack = SLACK * (1 + size_q * size_v.max())
    levels = [[statistics(m.astype(np.float64), n).astype(np.float32) for m in (q, v)] for n in SEGMENTS]
    seeds = min(2 * k, len(v_ids))
    found = []
    for a in range(0, len(q_ids), QUERIES_AT_ONCE):
        rows = np.arange(a, min(a + QUERIES_AT_ONCE, len(q_ids)))
        own = q_rows[rows, None] == v_rows[None, :]
        bound = levels[0][0][rows] @ levels[0][1].T
        bound[own] = -np.inf
        # thresholds: the k-th exact score among the 2k best by the coarse bound
        likely = np.argpartition(bound, len(v_ids) - seeds, axis=1)[:, len(v_ids) - seeds:]
        score = np.einsum("qd,qsd->qs", q[rows], v[likely]).astype(np.float64)
        score[np.take_along_axis(own, likely, axis=1)] = -np.inf
        threshold = np.sort(score, axis=1)[:, -k] if seeds >= k else np.full(len(rows), -np.inf)
        least = (threshold - slack[rows])[:, None]
        alive = (bound >= least) & ~own
        columns = np.flatnonzero(alive.any(axis=0))
        alive = alive[:, columns]
        for stats_q, stats_v in levels[1:]:
            alive &= stats_q[rows] @ stats_v[columns].T >= least
            left = alive.any(axis=0)
            columns, alive = columns[left], alive[:, left]
        exact = _products(q[rows], v[columns], exact_in_double)
        alive &= exact >= threshold[:, None]
        qi, vi = np.nonzero(alive)
        exact, vi = exact[qi, vi], columns[vi]
        order = np.lexsort((v_ids[vi], -exact, qi))
        qi, vi, exact = qi[order], vi[order], exact[order]
        best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        asked = rows[qi[best]]
        found.append((q_rows[asked], q_ids[asked], v_ids[vi[best]], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _searcher(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *asked, q, q_width, v_rows, v_ids, v, v_width in zip(*[c.to_pylist() for c in batch.columns]):
                q_rows, q_ids, v_rows, v_ids = (np.frombuffer(x, np.int64) for x in (*asked, v_rows, v_ids))
                found = search(q_rows, q_ids, np.frombuffer(q, np.int64).reshape(-1, q_width),
                               v_rows, v_ids, np.frombuffer(v, np.int64).reshape(-1, v_width), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of all other rows of (vec_id, embedding) for every query row."""
    kept = vectors.select("vec_id", "embedding", is_query.alias("_query")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # row numbers are made once and written: they tell a query's own row from others of its vec_id
    rows = stage(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", scaled(F.col("embedding")).alias("v"), "_query"), "search-vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if("_query")).first()
    every = blocks(rows.select("row", "vec_id", "v"), max(1, -(-n // VECTORS_PER_BLOCK)), "search-blocks")
    groups = max(1, -(-n_queries // QUERIES_PER_BLOCK))
    asked = blocks(rows.filter("_query").select("row", "vec_id", "v"), groups, "search-queries")
    left = asked.select(F.col("block").alias("_b"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("numbers").alias("q"), F.col("width").alias("q_width"))
    # each vector block is sent once to every query block
    right = every.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("block"),
                         F.col("block").alias("of"), "rows", "ids", "numbers", "width")
    met = right.join(left, right["block"] == left["_b"]).repartition(F.col("block"), F.col("of"))
    found = met.select("q_rows", "q_ids", "q", "q_width", "rows", "ids", "numbers", "width").mapInArrow(_searcher(k), FOUND)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
  FROM e AS q JOIN e ON e.r <> q.r WHERE q.vec_id % 20 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM p WHERE rank <= {K}"""
