"""Near-duplicate documents by HyperMinHash sketches (operator 10).

A document is the set of its distinct word shingles. Its sketch has one register per bucket of the hash space: the number of
leading zeros of the bucket's least hash and the next mantissa bits; empty buckets borrow along a fixed probe order, so short
documents fill their sketch too. Registers are cut into bands; documents that agree in a band are candidates. A pair is
linked if its full sets reach the threshold; before that, pairs are dropped whose set sizes rule it out, or whose Jaccard
estimate from the registers, corrected for chance collisions, is below a floor far under the threshold.

No group is ever expanded into rows for all its pairs. Equal sets collapse to one class first. In every band bucket, the classes
are compared with a leader (the smallest id; in further rounds, if asked for, one drawn per bucket), and linked classes become
one component. What is left are classes of a bucket in different components. In small buckets these meet as pairs. In
large ones they are compared block against block inside tasks, by products of shingle incidence matrices, and only a spanning
forest of the links found comes out; overlapping large buckets are compared as one group where that is less work. So no link
between components is missed that shares a bucket. With 32 bands of 4 registers a pair at the threshold misses every bucket
with probability below 1e-10.

Defined cases: a null text is empty; a document without words is linked with nothing; documents without an id are linked with
nothing and kept; rows that share a doc_id are one document, linked by any of their texts; an empty table gives no rows;
further columns are kept by `keep_one` and otherwise ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage
from shelfwise.llm.components import components
from shelfwise.llm.shingles import buffers, mix64, pieces, shingle_sets
from shelfwise.llm.text import ROW, with_row

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BAND = 4
BANDS = BUCKETS // BAND
#: Below so many shingles the registers repeat each other, and the estimate is not used.
ESTIMATE_FROM = 256
LEADER_ROUNDS = 1
#: Open classes of a bucket up to which they meet as pairs; shingles and rows in a block of a larger group; columns of a product.
SMALL_BUCKET = 16
BLOCK_SHINGLES = 1 << 20
BLOCK_ROWS = 2000
COLUMNS = 2048

_PROBES = np.argsort(np.random.default_rng(23).random((BUCKETS, BUCKETS)), axis=1)
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
_SALTS = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


@dataclass(frozen=True)
class Threshold:
    """Link where 100 * intersection >= percent * union."""
    percent: int = 85

    @property
    def floor(self) -> float:
        """Estimates below it cannot belong to a linked pair: six standard deviations under the threshold."""
        p = self.percent / 100
        return p - 6 * (p * (1 - p) / BUCKETS) ** 0.5


def registers(least: np.ndarray) -> np.ndarray:
    """16-bit registers of least hashes within a bucket: leading zeros, then the mantissa bits after the first one."""
    rest = (least << np.uint64(BUCKET_BITS)) >> np.uint64(11)
    fraction, exponent = np.frexp(rest.astype(np.float64))
    mantissa = np.floor((2 * fraction - 1) * (1 << MANTISSA_BITS)).clip(0)
    return (((53 - exponent) << MANTISSA_BITS) | mantissa.astype(np.int64)).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per non-empty sorted set."""
    out = np.zeros((len(sets), BUCKETS), np.uint64)
    filled = np.zeros((len(sets), BUCKETS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, _EDGES)
        at[at == len(s)] = len(s) - 1
        out[i] = s[at]
        filled[i] = (s[at] >> np.uint64(64 - BUCKET_BITS)) == np.arange(BUCKETS, dtype=np.uint64)
    source = np.empty((len(sets), BUCKETS), np.int64)
    for a in range(0, len(sets), 64):
        source[a:a + 64] = _PROBES[np.arange(BUCKETS), filled[a:a + 64][:, _PROBES].argmax(axis=2)]
    own = np.broadcast_to(np.arange(BUCKETS), source.shape)
    return registers(np.take_along_axis(out, np.where(filled, own, source), axis=1))


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row."""
    packed = np.ascontiguousarray(regs).view(np.uint64)
    return mix64(packed ^ _SALTS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in pieces(whole)):
        sets = list(shingle_sets(*buffers(batch.column(1))))
        some = [s for s in sets if len(s)]
        regs = iter(sketches(some))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
            pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary())],
            names=["doc_id", "n_shingles", "digest", "registers"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            regs = np.frombuffer(buffers(batch.column(1))[0], np.uint16).reshape(-1, BUCKETS)
            keys = band_keys(regs).view(np.int64)
            reps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(reps)], names=["key", "rep"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in pieces(whole)):
        sets = [s.tobytes() for s in shingle_sets(*buffers(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, less the registers that agree by chance."""
    chance = 1 / (3 << MANTISSA_BITS)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _likely(limit: Threshold) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(buffers(batch.column(c))[0], np.uint16).reshape(-1, BUCKETS) for c in ("regs_a", "regs_b"))
                n = np.minimum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array((estimates(a, b) >= limit.floor) | (n < ESTIMATE_FROM)))

    return keep


def _linked(limit: Threshold) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.intersect1d(one, two, assume_unique=True).size
                good.append(100 * both >= limit.percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return keep


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs (a, b) of class representatives whose sets reach the threshold."""
    one = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("regs_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("regs_b"))
    sized = pairs.join(one, "a").join(two, "b").filter(100 * F.least("n_a", "n_b") >= limit.percent * F.greatest("n_a", "n_b"))
    likely = sized.mapInArrow(_likely(limit), "a bigint, b bigint")
    first = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    second = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    return likely.join(first, "a").join(second, "b").mapInArrow(_linked(limit), "a bigint, b bigint")


def _leader(number: int) -> Column:
    """The aggregate that names the leader of a bucket in a round, with its component."""
    draw = F.xxhash64("rep", "key", F.lit(number)) if number else F.lit(0).cast("bigint")
    return F.min(F.struct(draw.alias("draw"), F.col("rep"), F.col("component")))


def intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of `one` with every set of `two`."""
    values = np.concatenate([*one, *two])
    row = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    _, column, found = np.unique(values, return_inverse=True, return_counts=True)
    shared = found > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for a in range(0, int(shared.sum()), COLUMNS):
        piece = slice(*np.searchsorted(column, (a, a + COLUMNS)))
        dense = np.zeros((len(one) + len(two), COLUMNS), np.float32)
        dense[row[piece], column[piece] - a] = 1
        out += dense[:len(one)] @ dense[len(one):].T
    return out.astype(np.int64)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    seen, out = np.zeros(len(linked), bool), []
    for root in range(len(linked)):
        front = np.zeros(0, np.int64) if seen[root] else np.array([root])
        seen[root] = True
        while len(front):
            rows = linked[front]
            new = np.flatnonzero(rows.any(axis=0) & ~seen)
            out += [(int(front[parent]), int(child)) for parent, child in zip(rows[:, new].argmax(axis=0), new)]
            seen[new] = True
            front = new
    return out


def _compare_blocks(limit: Threshold) -> Callable:
    def compare(table: pa.Table) -> pa.Table:
        """Links between the classes of two blocks of a group (or within one), as a spanning forest."""
        rows = table.select(["rep", "component", "block", "shingles"]).to_pylist()
        low = min(r["block"] for r in rows)
        one = [r for r in rows if r["block"] == low]
        two = [r for r in rows if r["block"] != low]
        if not two and table.column("low")[0].as_py() != table.column("high")[0].as_py():
            one, two = [], []
        edges: list[tuple[int, int]] = []
        if one:
            two = two or one
            sets = [[np.frombuffer(r["shingles"], np.uint64) for r in side] for side in (one, two)]
            sizes = [np.array([len(s) for s in side]) for side in sets]
            both = intersections(*sets)
            apart = np.array([r["component"] for r in one])[:, None] != np.array([r["component"] for r in two])[None, :]
            linked = (100 * both >= limit.percent * (sizes[0][:, None] + sizes[1][None, :] - both)) & apart
            if two is not one:
                square = np.zeros((len(rows), len(rows)), bool)
                square[:len(one), len(one):], square[len(one):, :len(one)] = linked, linked.T
                linked = square
            members = one if two is one else [*one, *two]
            edges = [(members[i]["rep"], members[j]["rep"]) for i, j in spanning(linked)]
        return pa.table([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return compare


def _large_groups(rows: DataFrame) -> DataFrame:
    """(grp, rep, component) of large open buckets: a cluster of overlapping buckets where all its pairs are fewer, else the bucket."""
    heads = rows.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n"))
    joined = rows.join(heads, "key")
    clusters = components(joined.select(F.col("rep").alias("u"), F.col("head").alias("v"))).withColumnRenamed("component", "cluster")
    named = heads.join(clusters, F.col("head") == F.col("node"), "left").select("key", "n", F.coalesce("cluster", "head").alias("cluster"))
    placed = rows.join(named, "key")
    work = named.groupBy("cluster").agg(F.sum(F.col("n") * F.col("n")).alias("_by_bucket"))
    size = placed.groupBy("cluster").agg(F.count_distinct("rep").alias("_members"))
    cheaper = work.join(size, "cluster").select(F.col("cluster").alias("_c"), (F.col("_members") * F.col("_members") <= F.col("_by_bucket")).alias("_one"))
    # the verdict goes to the buckets first, one row each, then to the rows by bucket: no row is dealt by cluster
    flags = named.join(cheaper, F.col("cluster") == F.col("_c")).select("key", "cluster", "_one")
    joined = rows.join(flags, "key")
    group = F.when(F.col("_one"), F.struct(F.lit(0).cast("bigint").alias("kind"), F.col("cluster").alias("id")))
    return joined.select(group.otherwise(F.struct(F.lit(1).cast("bigint").alias("kind"), F.col("key").alias("id"))).alias("grp"),
                         "rep", "component").distinct()


def _linked_in_groups(groups: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Links (u, v) within groups, compared in blocks of bounded size."""
    sized = groups.join(sets, "rep").withColumn("n", F.octet_length("shingles") / 8)
    parts = sized.groupBy("grp").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_ROWS)).alias("parts"))
    placed = sized.join(parts, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other")
    met = placed.select("grp", "rep", "component", "shingles", "block", other)
    met = met.select("grp", "rep", "component", "shingles", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return met.groupBy("grp", "low", "high").applyInArrow(_compare_blocks(limit), "u bigint, v bigint")


def _mixed(bands: DataFrame, found: DataFrame | None) -> DataFrame:
    """Bucket rows (key, rep, component) of buckets that hold more than one component."""
    if found is None:
        labelled = bands.withColumn("component", F.col("rep"))
    else:
        labels = found.select(F.col("node").alias("rep"), "component")
        labelled = bands.join(labels, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    span = labelled.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low < _high")
    return labelled.join(span.select("key"), "key")


def _joined(edges: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if edges is None else edges.unionAll(more)


def _same_document(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (u, v) between the classes of rows that share a doc_id, which are one document; none where every id has one text."""
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("_low"), F.max("digest").alias("_high")).filter("_low < _high").select("doc_id")
    several = stage(several, "near-repeated-ids")
    if several.isEmpty():
        return None
    of_rows = rows.join(several, "doc_id").join(classes.select("digest", "rep"), "digest")
    heads = of_rows.groupBy("doc_id").agg(F.min("rep").alias("v"))
    return stage(of_rows.join(heads, "doc_id").select(F.col("rep").alias("u"), "v").filter("u <> v"), "near-repeated")


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, registers) of every document; digest and registers are null without words."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _sketch, "doc_id bigint, n_shingles bigint, digest binary, registers binary")


def near_duplicates(docs: DataFrame, limit: Threshold = Threshold()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = stage(sketch(docs), "near-sketch")
    whole = rows.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = stage(whole.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
                                                F.first("registers").alias("registers")), "near-classes")
    keyed = stage(classes.select("rep", "registers").mapInArrow(_bands, "key bigint, rep bigint"), "near-bands")
    bands = stage(_mixed(keyed, None).select("key", "rep"), "near-shared-bands")
    wanted = bands.select("rep").distinct()
    texts = docs.select(F.col("doc_id").alias("rep"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "rep", "left_semi")
    sets = stage(texts.mapInArrow(_sets, "rep bigint, shingles binary"), "near-sets")

    edges = _same_document(whole, classes)
    found = None if edges is None else components(edges)
    for number in range(LEADER_ROUNDS + 1):
        open_rows = stage(_mixed(bands, found), f"near-open-{number}")
        if open_rows.isEmpty():
            break
        if number < LEADER_ROUNDS:
            heads = open_rows.groupBy("key").agg(_leader(number).alias("lead"))
            across = open_rows.join(heads, "key").filter("component <> lead.component")
            pairs = across.select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b"))
        else:
            counted = open_rows.groupBy("key").agg(F.count("*").alias("_n"))
            counted = stage(open_rows.join(counted, "key"), "near-open-sized")
            large = counted.filter(F.col("_n") > SMALL_BUCKET).drop("_n")
            if not large.isEmpty():
                in_groups = _linked_in_groups(stage(_large_groups(large), "near-groups"), sets, limit)
                edges = _joined(edges, stage(in_groups, "near-group-links"))
            small = counted.filter(F.col("_n") <= SMALL_BUCKET)
            other = small.select("key", F.col("rep").alias("b"), F.col("component").alias("component_b"))
            pairs = small.select("key", F.col("rep").alias("a"), "component").join(other, "key")
            pairs = pairs.filter("a < b and component <> component_b").select("a", "b")
        new = _verified(stage(pairs.distinct(), f"near-pairs-{number}"), classes, sets, limit)
        new = stage(new.select(F.col("a").alias("u"), F.col("b").alias("v")), f"near-links-{number}")
        edges = _joined(edges, new)
        found = components(edges)

    if found is None:
        known = classes.select("digest", "rep", F.col("rep").alias("component"))
    else:
        known = classes.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("component_id"))
    joined = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    joined = joined.join(known, F.col("digest") == F.col("_digest"), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, limit: Threshold = Threshold()) -> DataFrame:
    """The documents of which no smaller doc_id is in the same component, with their columns as they were."""
    gone = near_duplicates(docs, limit).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    rows = with_row(docs, docs["doc_id"].alias("_doc"))
    return rows.join(gone, F.col("_doc") == F.col("_gone"), "left_anti").select(f"{ROW}.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
