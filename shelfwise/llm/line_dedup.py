"""Repeated lines or paragraphs across documents (operator 4).

Units are normalised (lower-case A-Z, single spaces) and digested; digests are grouped over the whole corpus, the occurrence with
the smallest (doc_id, unit number) stays, every other one is removed. What is grouped is one thin row per unit of at least
`min_words` words; a unit that stands in a third of all documents is combined before the shuffle, and only digests found twice
or more are joined back. Removed units are reported by their byte offsets in the original text.

A unit is a line, a paragraph, or a sentence: the latter ends at . ! ? before a blank, or with its line, and keeps the blanks before it.
`marked` takes one kind of unit. `marked_passages` takes lines and sentences in one pass over the text, so that a passage goes also
where it starts or ends inside a line: a repeated line goes with its line end, a line of which all sentences go stays as an empty one. Both
kinds are judged on the input. What stands first of a line's copies holds its sentences before all later copies, so something first always stays.
In one pass, rows that share a doc_id and have different texts lose what each of them repeats.

Defined cases: a null text is empty; documents without an id take no part and stay whole; rows that share a doc_id are one
document, so a unit kept in one is kept in all; an empty table gives no rows; further columns are kept by `clean`.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage
from shelfwise.llm.text import ROW, bind, whole, with_row

#: What parts one unit from the next.
LINE, PARAGRAPH = "\n", "\n\n"
#: Places between two sentences, of no length: after an end mark before a blank, and around line ends.
SENTENCE = r"(?<=[.!?])(?=[\x20\x09])|(?<=[^\n])(?=\n)|(?<=\n)(?=[^\n])"
#: The same, with every line end as a piece of its own.
PIECE = r"(?<=[.!?])(?=[\x20\x09])|(?<=[\s\S])(?=\n)|(?<=\n)(?=[\s\S])"
UNIT = pa.schema([("_a", pa.int64()), ("_b", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("start", pa.int64()),
                  ("stop", pa.int64()), ("line", pa.bool_()), ("digest", pa.binary())])
MIN_WORDS = 10
#: On sf0.1, of 44 pairs unlike otherwise that share 51 words or more, sentences from 10 words on left 1, from 7 words on none.
SENTENCE_WORDS = 7
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def normalised(unit: str) -> list[str]:
    return [w for w in _GAP.split(unit.translate(_LOWER)) if w]


def _between(separator: str) -> str:
    """What stands between two units in the text."""
    return "" if separator == SENTENCE else separator


def _unit_rows(separator: str, min_words: int) -> Callable:
    def cut(text: str) -> list[str]:
        return re.split(separator, text) if separator == SENTENCE else text.split(separator)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units, digests = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for number, unit in enumerate(cut(text.as_py())):
                    found = normalised(unit)
                    if len(found) >= min_words:
                        ids.append(doc_id)
                        units.append(number)
                        digests.append(hashlib.blake2b(" ".join(found).encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(units, pa.int32()), pa.array(digests, pa.binary())],
                                             names=["doc_id", "unit", "digest"])

    return rows


def repeated_units(docs: DataFrame, separator: str = LINE, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, units): numbers of the units that go, for documents that lose any."""
    texts = docs.select("doc_id", whole().alias("text")).filter(F.col("doc_id").isNotNull())
    found = stage(texts.mapInArrow(_unit_rows(separator, min_words), "doc_id bigint, unit int, digest binary"), "line-units")
    place = F.struct("doc_id", "unit")
    shared = found.groupBy(F.col("digest").alias("_digest")).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    shared = shared.filter("_first < _last").select("_digest", "_first")
    gone = found.join(shared, F.col("digest") == F.col("_digest")).filter(place > F.col("_first"))
    return gone.groupBy("doc_id").agg(F.collect_set("unit").alias("units"))


def marked(docs: DataFrame, separator: str = LINE, min_words: int = MIN_WORDS) -> DataFrame:
    """(_row, n_units, n_removed, removed, kept): `removed` lists the byte ranges (from, to) that go, `kept` is the text left."""
    gone = repeated_units(docs, separator, min_words).select(F.col("doc_id").alias("_gone"), F.array_sort("units").alias("_units"))
    rows = with_row(docs, docs["doc_id"].alias("_doc"), whole().alias("_text"))
    joined = rows.join(gone, F.col("_doc") == F.col("_gone"), "left")
    units = F.transform(F.split("_text", separator), lambda u, i: F.struct(
        u.alias("text"), F.octet_length(u).alias("bytes"), F.coalesce(F.array_contains("_units", i), F.lit(False)).alias("gone")))
    step = len(_between(separator))

    def spans(all_units):
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("removed"))
        stop = lambda a, u: a["at"] + u["bytes"]
        add = lambda a, u: F.struct(
            (stop(a, u) + step).alias("at"),
            F.when(u["gone"], F.concat(a["removed"], F.array(F.struct(a["at"].alias("start"), stop(a, u).alias("stop")))))
            .otherwise(a["removed"]).alias("removed"))
        kept = F.array_join(F.transform(F.filter(all_units, lambda u: ~u["gone"]), lambda u: u["text"]), _between(separator))
        return F.struct(F.size(all_units).cast("bigint").alias("n_units"),
                        F.aggregate(all_units, start, add, lambda a: a["removed"]).alias("removed"), kept.alias("kept"))

    untouched = F.struct(F.size(F.split("_text", separator)).cast("bigint").alias("n_units"),
                         F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("removed"), F.col("_text").alias("kept"))
    judged = joined.select(ROW, F.when(F.col("_units").isNull(), untouched).otherwise(bind(units, spans)).alias("_j"))
    return judged.select(ROW, "_j.n_units", F.size("_j.removed").cast("bigint").alias("n_removed"), "_j.removed", "_j.kept")


def _passage_rows(min_words: int, sentence_words: int) -> Callable:
    """Units of both kinds: row key, doc_id, first piece and number of pieces, bytes from and to, whether it is a line, digest.

    Pieces are sentences and line ends. A line unit holds the line end before it.
    """
    def digest(kind: bytes, words: list[str]) -> bytes:
        return hashlib.blake2b(" ".join(words).encode(), digest_size=16, person=kind).digest()

    def of(text: str) -> Iterator[tuple[int, int, int, int, bool, bytes]]:
        found, line, at, byte = re.split(PIECE, text), [], 0, 0
        first, start = 0, 0
        for at, piece in enumerate([*found, "\n"]):
            if piece == "\n":
                words = [w for part in line for w in part]
                if len(words) >= min_words:
                    before = 1 if first else 0
                    yield first - before, at - first + before, start, byte, True, digest(b"line", words)
                line, first, start = [], at + 1, byte + 1
                byte += 1
                continue
            words, end = normalised(piece), byte + len(piece.encode())
            if len(words) >= sentence_words:
                yield at, 1, byte, end, False, digest(b"sentence", words)
            line.append(words)
            byte = end

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(3)]))
            out = [(*key, *unit) for key, text in zip(keys, batch.column(3)) for unit in of(text.as_py())]
            columns = list(zip(*out)) or [[] for _ in UNIT.names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, UNIT)], schema=UNIT)

    return rows


def marked_passages(docs: DataFrame, min_words: int = MIN_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """(_row, n_units, n_removed, removed, kept): sentences (also those that go with their line) and those that go, byte ranges
    (from, to) of removed lines and of sentences removed elsewhere, and the text left."""
    key = [F.xxhash64("doc_id", "text").alias("_a"), F.xxhash64(F.lit(4), "text", "doc_id").alias("_b")]
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).filter(F.col("doc_id").isNotNull())
    units = texts.select(*key, F.col("doc_id").cast("bigint"), whole().alias("text")).mapInArrow(
        _passage_rows(min_words, sentence_words), "_a bigint, _b bigint, doc_id bigint, at int, n int, start bigint, stop bigint, line boolean, digest binary")
    found = stage(units, "passage-units")
    place = F.struct("doc_id", "start")
    shared = found.groupBy(F.col("digest").alias("_digest")).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    gone = found.join(shared.filter("_first < _last").select("_digest", "_first"), F.col("digest") == F.col("_digest")).filter(place > F.col("_first"))
    # a line before the sentences in it, so that spans inside another one come after it
    units = F.collect_set(F.struct("start", (-F.col("stop")).alias("back"), "at", "n", "line"))
    per_row = gone.groupBy("_a", "_b").agg(F.array_sort(units).alias("_gone")).select(F.col("_a").alias("_ga"), F.col("_b").alias("_gb"), "_gone")
    rows = with_row(docs, *key, whole().alias("_text"))
    joined = rows.join(per_row, (F.col("_a") == F.col("_ga")) & (F.col("_b") == F.col("_gb")), "left")

    places = F.array_sort(F.array_distinct(F.flatten(F.transform("_gone", lambda u: F.sequence(u["at"], u["at"] + u["n"] - 1)))))
    outer = F.aggregate(
        "_gone", F.array().cast("array<struct<start:bigint,stop:bigint>>"),
        lambda a, u: F.when((F.size(a) > 0) & (F.element_at(a, -1)["stop"] >= -u["back"]), a)
        .otherwise(F.concat(a, F.array(F.struct(u["start"].alias("start"), (-u["back"]).alias("stop"))))))
    sentence = lambda p: (p != "\n") & (p != "")
    first_line = F.exists("_gone", lambda u: u["line"] & (u["at"] == 0))

    def judge(state: Column) -> Column:
        pieces, out = state["pieces"], state["out"]
        after = F.concat(F.array(F.lit(0)), F.transform(out, lambda g: g + 1))
        upto = F.concat(out, F.array(F.size(pieces)))
        left = F.flatten(F.zip_with(after, upto, lambda a, b: F.slice(pieces, a + 1, b - a)))
        text = F.array_join(left, "")
        return F.struct(F.size(F.filter(pieces, sentence)).cast("bigint").alias("n_units"),
                        (F.size(F.filter(pieces, sentence)) - F.size(F.filter(left, sentence))).cast("bigint").alias("n_removed"), outer.alias("removed"),
                        F.when(first_line, F.regexp_replace(text, r"\A\n", "")).otherwise(text).alias("kept"))

    pieces = F.split("_text", PIECE)
    untouched = F.struct(F.size(F.filter(pieces, sentence)).cast("bigint").alias("n_units"), F.lit(0).cast("bigint").alias("n_removed"),
                         F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("removed"), F.col("_text").alias("kept"))
    state = F.struct(pieces.alias("pieces"), places.alias("out"))
    judged = joined.select(ROW, F.when(F.col("_gone").isNull(), untouched).otherwise(bind(state, judge)).alias("_j"))
    return judged.select(ROW, "_j.*")


def _cleaned(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents with what is marked taken out; those that lose units and have no word left are dropped."""
    rows = marks.filter((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"{ROW}.text")),
           "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("bigint")).otherwise(F.col(f"{ROW}.n_chars"))
           if "n_chars" in docs.columns else None}
    return rows.select([(new[c] if c in new else F.col(f"{ROW}.`{c}`")).alias(c) for c in docs.columns])


def clean(docs: DataFrame, separator: str = LINE, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated units taken out; those that lose units and have no word left are dropped.

    Columns stay as they were but for `text`, and `n_chars` where there is one.
    """
    return _cleaned(docs, marked(docs, separator, min_words))


def clean_passages(docs: DataFrame, min_words: int = MIN_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """`clean` by lines, and by sentences of at least `sentence_words` words."""
    return _cleaned(docs, marked_passages(docs, min_words, sentence_words))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return rows.select(f"{ROW}.doc_id", "n_units", "n_removed", spans.alias("removed_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split(replace(regexp_replace(coalesce(text, ''), '([.!?])([\x20\x09])',
  '\1' || chr(1) || '\2', 'g'), chr(10), chr(1) || chr(10) || chr(1)), chr(1)), lambda p: p <> '') AS p FROM documents),
x AS (SELECT r, doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM d),
w AS (SELECT *, piece = chr(10) AS ends, strlen(piece) AS b, list_filter(regexp_split_to_array(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM x),
n AS (SELECT *, sum(b) OVER o - b AS pos, coalesce(sum(ends::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS line FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
l AS (SELECT r, doc_id, line, min(pos) AS pos, sum(b) AS b, string_agg(array_to_string(w, ' '), ' ' ORDER BY i) FILTER (len(w) > 0) AS norm
  FROM n WHERE NOT ends GROUP BY ALL HAVING sum(len(w)) >= {MIN_WORDS}),
lg AS (SELECT *, rank() OVER (PARTITION BY norm ORDER BY doc_id, pos) > 1 AS gone FROM l),
s AS (SELECT *, rank() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, pos) > 1 AS gone FROM n WHERE len(w) >= {SENTENCE_WORDS}),
g AS (SELECT n.*, coalesce(lg.gone, FALSE) AS line_gone, coalesce(lg.gone, FALSE) OR coalesce(s.gone, FALSE) AS gone, lg.pos AS line_pos, lg.b AS line_b
  FROM n LEFT JOIN lg USING (r, line) LEFT JOIN s ON s.r = n.r AND s.i = n.i WHERE NOT n.ends),
e AS (SELECT n.r, n.i, coalesce(lg.gone, FALSE) AS gone FROM n LEFT JOIN lg ON lg.r = n.r AND lg.line = n.line + 1 WHERE n.ends),
t AS (SELECT r, i, piece, gone FROM g UNION ALL SELECT r, i, chr(10), gone FROM e JOIN n USING (r, i)),
k AS (SELECT r, coalesce(string_agg(piece, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM t GROUP BY r),
q AS (SELECT r, string_agg(a || '-' || z, ',' ORDER BY a) AS spans FROM (SELECT DISTINCT r, CASE WHEN line_gone THEN line_pos ELSE pos END::BIGINT AS a,
  CASE WHEN line_gone THEN line_pos + line_b ELSE pos + b END::BIGINT AS z FROM g WHERE gone) GROUP BY r),
c AS (SELECT r, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, bool_or(line_gone AND line = 0) AS first_gone FROM g GROUP BY r)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(spans, '') AS removed_spans,
  sha256(CASE WHEN first_gone AND kept[1] = chr(10) THEN kept[2:] ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r) LEFT JOIN q USING (r)"""
