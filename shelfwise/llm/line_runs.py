"""Lines found in many documents, dropped everywhere, by levelled sorted runs of line hashes (operator 12).

`LineRuns` is a family of sorted runs in a folder. A run holds (digest, n_docs), bucketed by digest and sorted inside a bucket, so
that runs and batches meet in merge joins without a shuffle of the runs. A batch of documents is counted per digest; the merge with
the runs, newest first, adds what is known of a digest, and anti-joins those that are settled: found in `min_docs` documents
already, hence stored once and never again. What is left becomes a run of level 0. As soon as a level holds FANOUT runs they are
compacted into one run of the next level. The state that names the runs is published last (functions/versions.py), so that a batch
that dies leaves the family as it was, and a later session can open the folder and add batches.

A document belongs to one batch. The key of a line is the line without ASCII white space at both ends, A-Z in lower case; digests
are 128 bits. A hot line sends one row per task and batch (documents are made distinct by (doc_id, digest), which no line can
heat); the join that finds the places of frequent lines has a shuffle on both sides, whose hot partitions adaptive execution
splits, or none where the frequent digests are few by Spark's own size threshold. Texts are shuffled once, by row.

Defined cases: a null or empty text is one empty line; keys of fewer than `min_chars` code points never go; a line counts once
per document, rows that share a doc_id are one document; rows without a doc_id count for no line, but lose frequent ones; equal
rows are treated alike; an empty table gives no rows; further columns are kept by `drop_frequent` and `clean`.
"""
from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import versions
from shelfwise.functions.staging import new_path, remove, stage
from shelfwise.llm.text import GAP_CHARS, ROW, bind, whole, with_row

MIN_DOCS = 10
MIN_CHARS = 1
#: Batches that `frequent_lines` cuts a table into, and runs of a level that are compacted into one of the next.
BATCHES = 4
FANOUT = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; lower() leaves other letters alone in pure ASCII only."""
    inner = F.btrim(line, F.lit(GAP_CHARS))
    return F.when(F.octet_length(inner) == F.char_length(inner), F.lower(inner)).otherwise(F.translate(inner, _UPPER, _LOWER))


class LineRuns:
    """A family of sorted runs (digest, n_docs) in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        found = versions.current(spark, folder)
        self.number, state = found or (0, {"min_docs": min_docs, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": []})
        if state["min_docs"] != min_docs:
            raise ValueError(f"{folder} settles lines at {state['min_docs']} documents, not at {min_docs}")
        self.min_docs, self.buckets, self.runs = min_docs, state["buckets"], state["runs"]

    def _read(self, run: dict) -> DataFrame:
        """The run as a bucketed table of the session catalog, which is where Spark keeps bucket layouts."""
        name = "line_run_" + run["name"]
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (digest BINARY, n_docs BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run['name']}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, level: int) -> dict:
        name = uuid.uuid4().hex
        (rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", f"{self.folder}/{name}").saveAsTable("line_run_" + name))
        return {"name": name, "level": level}

    def _publish(self, runs: list[dict]) -> None:
        state = {"min_docs": self.min_docs, "buckets": self.buckets, "runs": runs}
        self.number, self.runs = versions.publish(self.spark, self.folder, state, self.number), runs

    def add(self, lines: DataFrame) -> None:
        """Take a batch of (doc_id, digest) in; its documents are in no other batch."""
        held = lines.filter("doc_id IS NOT NULL").select("doc_id", "digest").distinct()
        batch = held.groupBy("digest").agg(F.count("*").alias("n_docs"))
        known = F.lit(None).cast("bigint")
        for k, run in enumerate(reversed(self.runs)):
            old = self._read(run).select(F.col("digest").alias(f"_d{k}"), F.col("n_docs").alias(f"_n{k}")).hint("merge")
            batch = batch.join(old, F.col("digest") == F.col(f"_d{k}"), "left")
            known = F.coalesce(known, F.col(f"_n{k}"))  # counts include those of older runs: the newest run that has a digest is right
        known = F.coalesce(known, F.lit(0))
        fresh = batch.filter(known < self.min_docs).select("digest", (F.col("n_docs") + known).alias("n_docs"))
        self._publish([*self.runs, self._write(fresh, 0)])
        self._compact()

    def _merged(self, newer: DataFrame, older: DataFrame) -> DataFrame:
        """Full outer merge join of two runs; the newer count includes the older one."""
        newer, older = newer.select(F.col("digest").alias("_d"), F.col("n_docs").alias("_n")), older.hint("merge")
        both = newer.join(older, F.col("_d") == F.col("digest"), "full_outer")
        return both.select(F.coalesce("_d", "digest").alias("digest"), F.coalesce("_n", "n_docs").alias("n_docs"))

    def _compact(self) -> None:
        """Merge full levels, newest run first. A join, not a union: Spark 4.1 takes a union of bucketed scans for bucketed itself."""
        level = 0
        while len(full := [r for r in reversed(self.runs) if r["level"] == level]) >= self.fanout:
            merged = self._write(functools.reduce(self._merged, map(self._read, full)), level + 1)
            self._publish([*(r for r in self.runs if r["level"] != level), merged])
            for run in full:  # only older states name them now
                self._drop(run)
            level += 1

    def _drop(self, run: dict) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS line_run_{run['name']}")
        remove(self.spark, f"{self.folder}/{run['name']}")

    def settled(self) -> DataFrame:
        """Digests found in `min_docs` documents or more, each once."""
        rows = [self._read(run).filter(F.col("n_docs") >= self.min_docs).select("digest") for run in self.runs]
        return functools.reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], "digest binary")

    def drop(self) -> None:
        """Remove the family with its files."""
        for run in self.runs:
            self._drop(run)
        remove(self.spark, self.folder)


def _row_key() -> list[Column]:
    """128 bits that tell rows apart by doc_id and text, null ids included."""
    return [F.xxhash64("doc_id", "text").alias("_a"), F.xxhash64(F.lit(12), "text", "doc_id").alias("_b")]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_a, _b, doc_id, line, digest): one thin row per line with a key of at least `min_chars` code points."""
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    rows = texts.select(*_row_key(), "doc_id", F.split(whole(), "\n").alias("_all"))  # keys of rows before rows are multiplied
    split = rows.select("_a", "_b", "doc_id", F.posexplode("_all").alias("line", "_text"))
    keyed = split.select("_a", "_b", "doc_id", "line", line_key(F.col("_text")).alias("_key"))
    return keyed.filter(F.char_length("_key") >= max(min_chars, 1)).select("_a", "_b", "doc_id", "line", F.unhex(F.md5("_key")).alias("digest"))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(_a, _b, lines): per row, by its key, the numbers of its lines that go, in order; rows that lose none are left out."""
    spark = docs.sparkSession
    path = new_path(spark, "lines")
    # a document's rows are all in one batch; each batch is a folder, so that it is read alone
    lines = _lines(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    lines.write.partitionBy("batch").parquet(path)
    found = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, new_path(spark, "line-runs"), min_docs)
    for number in range(batches):
        runs.add(found.filter(F.col("batch") == number))
    settled = stage(runs.settled().withColumnRenamed("digest", "_settled"), "settled-lines")
    runs.drop()
    gone = found.join(settled, F.col("digest") == F.col("_settled"))
    return gone.groupBy("_a", "_b").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def drop_frequent(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(_row, n_lines, dropped, kept): numbers of the lines that go, from 0, and the text that stays."""
    gone = frequent_lines(docs, min_docs, min_chars, batches).select(F.col("_a").alias("_ga"), F.col("_b").alias("_gb"), F.col("lines").alias("_gone"))
    rows = with_row(docs, *_row_key(), whole().alias("_text"))
    joined = rows.join(gone, (F.col("_a") == F.col("_ga")) & (F.col("_b") == F.col("_gb")), "left")

    def left(lines: Column) -> Column:
        """The lines between those that go, slice by slice: in time linear in the lines."""
        after = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda g: g + 1))
        upto = F.concat(F.col("_gone"), F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(after, upto, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    # a text without frequent lines is not cut
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(bind(F.split("_text", "\n"), left))
    return joined.select(ROW, F.size(F.split("_text", "\n")).cast("bigint").alias("n_lines"),
                         F.coalesce("_gone", F.array().cast("array<int>")).alias("dropped"), kept.alias("kept"))


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """The documents without their frequent lines; a text that loses none stays as it is, null included."""
    rows = drop_frequent(docs, min_docs, min_chars, batches)
    text = F.when(F.size("dropped") > 0, F.col("kept")).otherwise(F.col(f"{ROW}.text"))
    return rows.select([(text if c == "text" else F.col(f"{ROW}.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_frequent(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(f"{ROW}.doc_id", "n_lines", F.size("dropped").cast("bigint").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS u, row_number() OVER () AS r FROM documents),
x AS (SELECT r, doc_id, unnest(u) AS line, generate_subscripts(u, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM x),
f AS (SELECT key AS common FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*)::BIGINT AS n_lines, count(common)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = common GROUP BY r, doc_id"""
