"""Resampling towards a target distribution by hashed word n-grams.

A table of 256 bytes lower-cases A-Z and blanks the separators of a UTF-8 text,
``bytes.split`` yields its words, and CRC-32 runs on from a word over the next two,
which gives the hash of every run of 1 to 3 words without building the run.
Counters of the hash buckets are summed per task and then over all tasks. A
document's weight is the sum of its features' gains, and Gumbel noise makes the
highest scores a draw without replacement.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.llm.common import staged, table, tasks

BUCKETS = 10_000
SEED = 42
#: Documents with fewer words are never drawn.
MIN_WORDS = 20
#: Share that is drawn, in percent.
PERCENT = 5
#: Bytes of a text that are split into words at a time; it bounds memory, not results.
STEP = 1 << 20

KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
CLEAN = bytes(c if c in KEPT else ord(" ") for c in bytes(range(256)).lower())

WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def feature_hashes(text: bytes | None, step: int = STEP) -> Iterator[tuple[int, list[int]]]:
    """Number of further words, and the CRC-32 of all runs of 1 to 3 words that end in them, a stretch at a time."""
    clean = (text or b"").translate(CLEAN)
    before: list[bytes] = []
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + step)
        end = len(clean) if end < 0 else end
        new = clean[at:end].split()
        at = end
        words = before + new
        spaced = [b" " + w for w in words]
        one = list(map(crc32, words))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        k = len(before)
        yield len(new), one[k:] + two[max(k - 1, 0) :] + three
        before = words[-2:]


def _buckets(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, np.int64) % BUCKETS


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): how many features of all ``text`` fall into a bucket; a null text has none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[int] = Counter()
        for batch in batches:
            for text in batch["text"]:
                for _, hashes in feature_hashes(text):
                    n.update(_buckets(hashes).tolist())
        yield pd.DataFrame({"bucket": list(n.keys()), "n": list(n.values())}, dtype="int64")

    # At most BUCKETS rows leave a task, however many texts it reads.
    parts = texts.select(F.col("text").cast("binary").alias("text")).mapInPandas(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """What a feature of each bucket adds to a weight: floor of 1000 log-odds, target against docs, add-one smoothed."""
    both = (
        docs.sparkSession.range(BUCKETS)
        .withColumnRenamed("id", "bucket")
        .join(bucket_counts(docs).withColumnRenamed("n", "s"), "bucket", "left")
        .join(bucket_counts(target).withColumnRenamed("n", "t"), "bucket", "left")
        .fillna(0, ["s", "t"])
    )
    d = lambda c: c.cast("double")
    whole = both.agg(d(F.sum("s")).alias("all_s"), d(F.sum("t")).alias("all_t"))
    ratio = ((d(F.col("t")) + 1) * (F.col("all_s") + BUCKETS)) / ((d(F.col("s")) + 1) * (F.col("all_t") + BUCKETS))
    # One row per bucket, a fixed number, reaches the driver.
    rows = both.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    return out


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per document its words, its features and the sum of their gains."""

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = np.zeros((len(batch), 3), np.int64)
            for k, text in enumerate(batch["text"]):
                for words, hashes in feature_hashes(text):
                    rows[k] += (words, len(hashes), gain[_buckets(hashes)].sum())
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "n_words": rows[:, 0], "n_features": rows[:, 1], "weight": rows[:, 2]}
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInPandas(weigh, WEIGHTS)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by the seed and the doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Add ``rank`` (1, 2, ...) to the floor(percent * N / 100) best of the N rows with enough words, null to others.

    Rows are placed in order into range partitions and numbered in them; one row per
    partition carries what the partitions before it hold. No task sees all rows.
    """
    spark = scored.sparkSession
    numbered = staged(scored.withColumn("_row", F.monotonically_increasing_id()), "importance-scores")
    able = F.col("n_words") >= min_words
    keys = [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    ordered = numbered.repartitionByRange(tasks(spark), *keys).sortWithinPartitions(*keys)
    # The number of a row is its partition's number in the high bits and its place in the low 33.
    placed = staged(ordered.withColumn("_at", F.monotonically_increasing_id()), "importance-order")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(able.cast("long")).alias("_able")
    )
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.floor(F.sum("_able").over(W.partitionBy()) * percent / 100).alias("_drawn"),
    )
    rank = place + F.col("_before") + 1
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("rank", F.when(able & (rank <= F.col("_drawn")), rank).cast("long"))
        .drop("_part", "_row", "_at", "_before", "_drawn")
    )


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` against the texts of ``target``.

    Null and empty texts have no features and weight 0. A row without doc_id has the
    noise of an empty id and comes last among equal scores; rows that share a doc_id
    are documents of their own, and equal scores of theirs follow the order in which
    they were read. Empty ``docs`` give no rows; an empty ``target`` counts as one
    that has seen every bucket equally often. Other columns are ignored.
    """
    scored = weights(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(scored, percent, min_words)


def op12_importance(spark, sf_dir: str) -> DataFrame:
    """All documents against the benchmark's texts; the best 5 % are ranked."""
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 is linear: the state after a text is the exclusive or of one table value per byte, chosen by the byte and its
# distance from the end, and of the initial state run over as many zero bytes.
OP12_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark
), split AS (
  SELECT side, id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM texts
), places AS (
  SELECT side, id, w, unnest(range(1, len(w) + 1)) AS i FROM split
), features AS (
  SELECT side, id, unnest([w[i], CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END,
                           CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END]) AS f
  FROM places
), counted AS (
  SELECT side, id, f, count(*) AS n FROM features WHERE f IS NOT NULL GROUP BY ALL
), names AS (
  SELECT DISTINCT f, hex(encode(f)) AS x FROM counted
), one AS (
  SELECT b::UBIGINT AS b, printf('%02X', b) AS x,
         list_reduce([b::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                     lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
  FROM range(256) AS r(b)
), longest AS (
  SELECT coalesce(max(length(x)) // 2, 0) AS n FROM names
), steps AS (
  SELECT 0 AS k, x, v FROM one
  UNION ALL
  SELECT k + 1, s.x, xor(s.v >> 8, one.v) FROM steps s JOIN one ON one.b = s.v & 255 WHERE k + 1 < (SELECT n FROM longest)
), init AS (
  SELECT 0 AS k, 4294967295::UBIGINT AS v
  UNION ALL
  SELECT k + 1, xor(i.v >> 8, one.v) FROM init i JOIN one ON one.b = i.v & 255 WHERE k < (SELECT n FROM longest)
), bytes AS (
  SELECT f, length(x) // 2 AS n, substr(x, 2 * j + 1, 2) AS x, length(x) // 2 - 1 - j AS k
  FROM (SELECT f, x, unnest(range(length(x) // 2)) AS j FROM names)
), buckets AS (
  SELECT f, (xor(xor(bit_xor(steps.v), any_value(init.v)), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket
  FROM bytes JOIN steps ON steps.k = bytes.k AND steps.x = bytes.x JOIN init ON init.k = bytes.n
  GROUP BY f
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t
  FROM counted JOIN buckets USING (f) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE
                               / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS g
  FROM sums
), weighed AS (
  SELECT id, sum(n * g)::BIGINT AS weight FROM counted JOIN buckets USING (f) JOIN gain USING (bucket)
  WHERE side = 's' GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features,
         coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                    / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (id) WHERE side = 's'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r,
         count(*) FILTER (n_words >= 20) OVER () AS able
  FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       (CASE WHEN n_words >= 20 AND r <= 5 * able // 100 THEN r END)::BIGINT AS rank
FROM ranked
"""
