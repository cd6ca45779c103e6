"""Line dedup: lines that several documents hold stay only in the first of them.

Hashes of the normalised lines are partitioned by range and sorted by document
and position; a stream over each range sees the first occurrence before all
others. No text is shuffled for that: the result is one compressed bitmap of
dropped lines per document, and only applying it touches the texts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentria.llm.common import WHITE, ascii_lower, bind, staged, tasks

#: A frequent line is spread over so many ranges; rare lines are not affected.
SALTS = 64


def _row_key():
    """Tells rows apart that share a doc_id; equal rows have equal bitmaps anyway."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(h1, h2, salt, doc_id, row_key, pos) of every line whose key has ``min_chars`` code points.

    Rows without doc_id hold no lines here.
    """
    exploded = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", _row_key().alias("row_key"), F.posexplode(_lines(F.col("text"))).alias("pos", "line")
    )
    keyed = exploded.select(
        "doc_id", "row_key", "pos", ascii_lower(F.btrim(F.col("line"), F.lit(WHITE))).alias("key")
    ).where(F.length("key") >= min_chars)
    return keyed.select(
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), "key").alias("h2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        "doc_id",
        "row_key",
        "pos",
    )


def drop_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row per document with dropped lines: doc_id, row_key, drops.

    ``drops`` is a sparse bitmap, an array of (word, bits): bit b of word w marks
    line 64 * w + b. Words without a mark are left out.
    """
    spark = docs.sparkSession
    ranged = line_hashes(docs, min_chars).repartitionByRange(tasks(spark), "h1", "h2", "salt")
    # The ranges keep (h1, h2, salt) together, so this window needs no further exchange.
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos")
    seen = staged(ranged.withColumn("first_doc", F.first("doc_id").over(stream)), "line-first")
    later = seen.where("doc_id > first_doc").select("doc_id", "row_key", "pos")
    # What is left of a frequent line: one document per salt.
    heads = seen.where("doc_id = first_doc").groupBy("h1", "h2", "doc_id", "row_key").agg(
        F.collect_list("pos").alias("positions")
    )
    keeper = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    beaten = (
        heads.withColumn("keeper", keeper)
        .where("doc_id > keeper")
        .select("doc_id", "row_key", F.explode("positions").alias("pos"))
    )
    marked = later.unionByName(beaten).groupBy("doc_id", "row_key", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    return marked.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def kept_text(text, drops):
    """The text without its marked lines; ``drops`` null or empty: the text itself."""
    dense = bind(
        F.map_from_entries(drops),
        lambda m: F.transform(
            F.sequence(F.lit(0), F.array_max(F.map_keys(m))), lambda w: F.coalesce(F.try_element_at(m, w), F.lit(0))
        ),
    )

    def keeps(words):
        def keep(_, i):
            word = F.coalesce(F.get(words, F.call_function("shiftright", i, F.lit(6))), F.lit(0))
            return F.call_function("shiftright", word, i % 64) % 2 == 0

        return keep

    cut = bind(dense, lambda words: F.array_join(F.filter(_lines(text), keeps(words)), "\n"))
    return F.when(drops.isNull(), F.coalesce(text, F.lit(""))).otherwise(cut)


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Every row of ``docs`` with all its columns, ``text`` cut, and n_lines, n_dropped, drops.

    A line's key is the line without white space at both ends, A-Z in lower case.
    Keys of ``min_chars`` code points or more in two or more documents lose all
    lines except those in the document with the smallest doc_id. Null or empty
    text is one empty line. Rows without doc_id are kept as they are and neither
    lend nor lose lines; rows that share a doc_id are one document to the rule.
    Columns named n_lines, n_dropped or drops are replaced.
    """
    maps = drop_bitmaps(docs, min_chars)
    own = docs.drop("n_lines", "n_dropped", "drops")
    joined = own.withColumn("__row_key", _row_key()).join(
        maps.select(F.col("doc_id").alias("__doc_id"), F.col("row_key").alias("__map_key"), "drops"),
        (F.col("doc_id") == F.col("__doc_id")) & (F.col("__row_key") == F.col("__map_key")),
        "left",
    )
    dropped = F.coalesce(F.aggregate("drops", F.lit(0), lambda n, x: n + F.bit_count(x["bits"])), F.lit(0))
    return joined.select(
        *[c for c in own.columns if c != "text"],
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
        "drops",
        kept_text(F.col("text"), F.col("drops")).alias("text"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id > s.keeper AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
