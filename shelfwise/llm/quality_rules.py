"""Quality rules as a ledger of failure bits and measurements (operator 7).

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy is a
versioned mask of the bits that count, so changing a policy or asking what a rule costs never reads a text again. JVM functions
only, no shuffle but for the ablation, which adds up rows per distinct bit pattern (at most 2^rules) before it shuffles.

Defined cases: a null text is empty; an empty text fails `too_few_words`; repeated rows are judged each on its own; further
columns of the input are ignored, whatever their names; a null doc_id is passed through.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.text import GAP_CHARS, ROW, bind, whole, with_row, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Rule by name in the order of its bit; each is a condition on the measurements that means failure.
RULES: Mapping[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 4 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "exclamations": "2 * n_exclamations > n_words",
    "bullet_lines": "10 * n_bullet_lines > 9 * n_lines and n_lines > 1",
    "cut_lines": "10 * n_cut_lines > 3 * n_lines and n_lines > 1",
}
BASE_RULES = ("too_few_words", "repeated_windows")

#: Rules that count, by policy version. The newest is the last.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "v1": (*BASE_RULES, "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_bullet_lines",
            "n_cut_lines")


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def _count_of(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def repeated_words(w: Column) -> Column:
    """Words that stand in a window found twice or more. Sorting happens only where two windows agree."""
    last = F.size(w) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.filter(s, lambda x, j: F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
                            | ((j > 0) & F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))))
            starts = F.sort_array(F.transform(same, lambda x: x["i"]))
            begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            add = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))
            return F.aggregate(starts, begin, add, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(placed, twice))

    return F.when(last < 1, F.lit(0)).otherwise(bind(hashes, covered))


def ledger(docs: DataFrame) -> DataFrame:
    """The packed input row, the measurements (bigint) and `fail_bits` of every document."""
    text = whole()
    of_words = bind(words(text), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(GAP_CHARS)) != "")
    of_lines = bind(lines, lambda x: F.struct(
        F.size(x).alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        F.size(F.filter(x, lambda y: F.ltrim(y).substr(1, 1).isin("-", "*", "•"))).alias("n_bullet_lines"),
        F.size(F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))).alias("n_cut_lines")))
    measured = with_row(
        docs, of_words.alias("_w"), of_lines.alias("_l"),
        F.char_length(F.translate(text, GAP_CHARS, "")).alias("word_chars"),
        _count_of(text, SYMBOLS).alias("n_symbols"), _count_of(text, "!").alias("n_exclamations"))
    flat = measured.select(ROW, "_w.*", "_l.*", "word_chars", "n_symbols", "n_exclamations")
    flat = flat.select(ROW, *[F.col(m).cast("bigint").alias(m) for m in MEASURES])
    bits = sum(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values()))
    return flat.withColumn("fail_bits", bits.cast("bigint"))


def verdict(policy: str = CURRENT) -> Column:
    """Whether the ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that would pass if only this rule were dropped."""
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    held = counts.withColumn("held", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))))
    per_rule = [F.struct(F.lit(name).alias("rule"), F.lit(mask((name,))).cast("bigint").alias("bit")) for name in POLICIES[policy]]
    exploded = held.select("held", "n", F.explode(F.array(*per_rule)).alias("r"))
    fails = F.col("held").bitwiseAND(F.col("r.bit")) != 0
    return (exploded.groupBy(F.col("r.rule").alias("rule"))
            .agg(F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("n_failed"),
                 F.coalesce(F.sum(F.when(F.col("held") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only_this")))


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that pass a policy, with their columns as they were."""
    return ledger(docs).filter(verdict(policy)).select(f"{ROW}.*")


def query(spark, sf_dir: str) -> DataFrame:
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE_RULES))) != 0
    return rows.select(f"{ROW}.doc_id", *MEASURES, "fail_bits", base.alias("base_failed"), verdict().alias("kept"))


def _sql() -> str:
    gap, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
    trim = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '{word}') AS w FROM d),
v AS (SELECT k, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s
      FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT k, s FROM v GROUP BY k, s HAVING count(*) > 1),
c AS (SELECT k, count(DISTINCT i + j) AS n FROM v JOIN r USING (k, s) CROSS JOIN range(0, 5) AS o(j) GROUP BY k),
l AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: trim(x, {trim}) <> '') AS x FROM d),
m AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '{gap}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(x)::BIGINT AS n_lines,
  (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclamations,
  len(list_filter(x, lambda y: left(ltrim(y, ' '), 1) IN ('-', '*', '•')))::BIGINT AS n_bullet_lines,
  len(list_filter(x, lambda y: rtrim(y, ' ') LIKE '%...' OR rtrim(y, ' ') LIKE '%…'))::BIGINT AS n_cut_lines
  FROM d JOIN w USING (k) JOIN l USING (k) LEFT JOIN c USING (k)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, {', '.join(MEASURES)}, fail_bits, (fail_bits & {mask(BASE_RULES)}) <> 0 AS base_failed,
  (fail_bits & {mask(POLICIES[CURRENT])}) = 0 AS kept FROM b"""


SQL = _sql()
