"""Mixing sources to target weights by systematic sampling (operator 6).

Every source gets a share of the corpus size by its weight, at most `MOST` times its own size; what a capped source cannot take
goes to the others by weight. A document of a source is expected target / source size times. Documents are laid out in a row
within their source, each as long as its expected copies; one offset per source is drawn from a seeded hash, and a document is
emitted once per whole number that its stretch crosses. The row is ordered by size, so the taken words miss the target by about
one document at most. Positions come from a range-partitioned numbering, so a source with a third of all rows is many slices.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are emitted
like any other and take nothing; rows that share doc_id and source are one document, whose size is their sum; an empty table
gives no rows; further columns are kept by `mix`, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.ordering import running_totals
from shelfwise.functions.staging import stage
from shelfwise.llm.text import ROW, whole, with_row, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source of (source, source_size, n): its target and the rows of earlier sources. Rows: one per source, so the two windows hold the list of sources only.

    With level L = (total - capped) / (weight of the rest), sources below their cap get L times their weight. Sources are taken
    in the order of cap / weight: the capped ones are a prefix of it, namely those whose cap is below what L would give them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(w) for w in weights])
    earlier = by_name.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    weighed = sizes.withColumn("weight", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)).cast("double"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) - F.coalesce(MOST * F.sum("source_size").over(before), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the level rises as long as the next source is capped and falls from the first one that is not: its highest value is theirs
    settled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    cap = (MOST * F.col("source_size")).cast("double")
    return settled.select("source", "source_size", "first", F.least(F.col("level") * F.col("weight"), cap).alias("target"))


def _offset(source: Column) -> Column:
    """A number in [0, 1) per source, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.concat(F.lit("="), source), F.lit(""))))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def sampled(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every document. The text stays behind once it is counted."""
    counted = docs.select("doc_id", "source", word_count(whole()).alias("size"))
    sizes = stage(counted.groupBy("doc_id", "source").agg(F.sum("size").alias("size")), "mix-sizes")
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc()]
    numbered = running_totals(sizes, order, {"_at": F.lit(1).cast("bigint")}, "mix-order")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    named = stage(targets(per_source), "mix-targets").withColumnRenamed("source", "_source")
    joined = numbered.join(named, F.col("source").eqNullSafe(F.col("_source")), "left")
    expected = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    place, offset = F.col("_at") - F.col("first"), _offset(F.col("source"))
    copies = F.floor(place * expected + offset) - F.floor((place - 1) * expected + offset)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: every row as often as the sampling emits its document."""
    emitted = sampled(docs).filter(F.col("copies") > 0).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), "copies")
    rows = with_row(docs, docs["doc_id"].alias("_doc"), docs["source"].alias("_src"))
    joined = rows.join(emitted, F.col("_doc").eqNullSafe(F.col("_d")) & F.col("_src").eqNullSafe(F.col("_s")))
    return joined.select(ROW, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(f"{ROW}.*")


def query(spark, sf_dir: str) -> DataFrame:
    rows = sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = rf"""
WITH d AS (SELECT doc_id, source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS size
  FROM documents GROUP BY ALL),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}]::DOUBLE AS w
  FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce({MOST} * sum(source_size) OVER b, 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lvl FROM w
  WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size,
  least(w * max(lvl) OVER (), {MOST}::DOUBLE * source_size) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS pos,
  coalesce(t.target / nullif(t.source_size, 0), 0) AS e,
  ('0x' || left(md5('{SEED}:' || coalesce('=' || d.source, '')), 7))::BIGINT / {float(1 << 28)} AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(pos * e + u) - floor((pos - 1) * e + u))::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c"""
