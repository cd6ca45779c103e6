"""Quality rules: every rule is evaluated once into a ledger of failure bits and measurements.

Policies are versioned bit masks over the ledger; applying one, or asking what
each of its rules alone rejects, is bit arithmetic and never reads a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import WHITE, bind, windows_of, words

SYMBOLS = "#*$%&|<>"

#: Rule name and failure condition over the measurements; the place is the bit. New rules go to the end.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("long_words", "word_chars > 40 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("shouting", "n_shouted * 2 > n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: a document stays if none of the policy's bits is set.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": BIT["few_words"] | BIT["repeated_words"] | BIT["symbols"] | BIT["long_words"],
    "v2": sum(BIT.values()),
}


def _repeat_words(wins: Column) -> Column:
    """Positions covered by windows of 5 words whose hash occurs twice or more."""

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            same = lambda k, d: F.coalesce(F.get(s, k + d)["h"] == F.get(s, k)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
            places = F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))
            return F.aggregate(
                places,
                F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
                lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n")),
                lambda acc: acc["n"],
            )

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(bind(ordered, count))

    return bind(wins, covered)


def measurements(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but text, and the measurements of its text.

    Null text counts as empty: every measurement is 0, n_lines 1.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted", "failed")
    own = [c for c in docs.columns if c not in names and c != "text"]
    solid = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    size = lambda c: F.size(c).cast("long")
    parts = docs.select(
        *own,
        bind(
            words(F.col("text")),
            lambda w: F.struct(
                size(w).alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
                _repeat_words(windows_of(w, 5)).cast("long").alias("n_repeat_words"),
                size(F.filter(w, lambda x: (F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x)))).alias(
                    "n_shouted"
                ),
            ),
        ).alias("__m"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        size(F.split(text, "\n", -1)).alias("n_lines"),
        bind(solid, lambda s: size(s) - size(F.array_distinct(s))).alias("n_dup_lines"),
    )
    return parts.select(*own, "__m.*", "n_symbols", "n_lines", "n_dup_lines")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``, a bit per rule of ``RULES`` that the document fails."""
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measurements(docs).withColumn("failed", failed.cast("int"))


def passes(policy: str) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: how many documents fail it, fail only it, and stay without it.

    One aggregation over the ledger; an empty ledger gives zeros.
    """
    mask = POLICIES[policy]
    bad = F.col("failed").bitwiseAND(F.lit(mask))
    held = [(name, bit) for name, bit in BIT.items() if bit & mask]
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    sums = rows.agg(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                count(bad.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
                count(bad == bit).alias("n_only"),
                count(bad.bitwiseAND(F.lit(mask & ~bit)) == 0).alias("n_kept_without"),
            ).alias(name)
            for name, bit in held
        ]
    )
    return sums.select(F.explode(F.array(*[n for n, _ in held])).alias("r")).select("r.*")


def op10_quality_rules(spark, sf_dir: str, policy: str = "v2") -> DataFrame:
    """Measurements, base_failed and kept of every document, and the ledger's bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ledger(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes("base")).alias("base_failed"),
        passes(policy).alias("kept"),
        "failed",
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS solid
  FROM documents
), grams AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(solid) - len(list_distinct(solid)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(string_split(text, chr(10)))::BIGINT AS n_lines,
         len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x)))::BIGINT AS n_shouted
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), f AS (
  SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
          + 4 * (2 * n_symbols > n_words)::INT + 8 * (word_chars > 40 * n_words)::INT
          + 16 * (2 * n_dup_lines > n_lines)::INT + 32 * (2 * n_shouted > n_words)::INT)::INT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""
