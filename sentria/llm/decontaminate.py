"""Benchmark decontamination: SimHash of item-sized windows, multi-index search, exact check.

1. Shingles (five words) of the documents are tested against a bit set of the
   items' shingles; a window without any cannot reach the similarity.
2. Every window of an item's length is fingerprinted that holds enough shingles of
   items of that length to reach the similarity, wherever it starts. Its SimHash is
   found by multi-index blocks: fingerprints within ``RADIUS`` bits agree in at least
   one of ``RADIUS + 1`` blocks, so an equi-join on (length, block, value) misses none.
3. The weighted Jaccard similarity of window and item, shingles weighted by
   their number, is computed exactly for what is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import ascii_lower, bind, staged, windows_of, words

SHINGLE = 5
#: Bits in which the fingerprints of window and item may differ. Sets of similarity 0.8
#: differ in 9.7 of 64 bits on average (standard deviation 2.9).
RADIUS = 19
#: Bits of the set that hits are first looked up in; false hits fall out in the join behind it.
FILTER_BITS = 1 << 20
#: Item tables up to so many shingles are broadcast; larger ones are joined by shuffle.
BROADCAST_SHINGLES = 200_000


def _blocks() -> list[tuple[int, int]]:
    """(first bit, width) of RADIUS + 1 blocks that cover 64 bits."""
    edges = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shingles(text: Column) -> Column:
    """Hashes of all runs of five words, A-Z in lower case; with fewer words, of all words as one run."""
    return bind(
        words(ascii_lower(F.coalesce(text, F.lit("")))),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < SHINGLE, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(windows_of(w, SHINGLE)),
    )


def _places(h: Column) -> tuple[Column, Column]:
    """The two bits of a shingle."""
    return F.pmod(h, F.lit(FILTER_BITS)), F.pmod(F.shiftrightunsigned(h, 24), F.lit(FILTER_BITS))


def filter_bits(items: DataFrame) -> list[int]:
    """The items' shingles as a bit set of fixed size (``FILTER_BITS`` / 64 longs)."""
    h = items.select(F.explode("wins").alias("h")).select(F.explode(F.array(*_places(F.col("h")))).alias("b"))
    found = h.groupBy(F.expr("cast(b div 64 as int)").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")
    )
    out = [0] * (FILTER_BITS // 64)
    for w, bits in found.collect():
        out[w] = bits
    return out


def fingerprint(frame: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fp: SimHash of all rows (one per shingle occurrence, column h) of a key.

    Two 32-bit counters share a long, so 32 sums give 64 bit counts.
    """
    lane = lambda k: (F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1))) + F.shiftleft(
        F.shiftrightunsigned("h", k + 32).bitwiseAND(F.lit(1)), 32
    )
    sums = frame.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.sum(lane(k)).alias(f"__s{k}") for k in range(32)])
    low = lambda k: F.col(f"__s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("__n")
    high = lambda k: F.shiftrightunsigned(f"__s{k}", 32) * 2 > F.col("__n")
    bits = [F.when(low(k), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(32)]
    bits += [F.when(high(k), F.shiftleft(F.lit(1).cast("long"), k + 32)).otherwise(F.lit(0)) for k in range(32)]
    return sums.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def _with_blocks(frame: DataFrame) -> DataFrame:
    values = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)).alias("value"))
        for k, (a, w) in enumerate(_blocks())
    ]
    return frame.select("*", F.inline(F.array(*values)))


def _first_equal_block(x: Column) -> Column:
    """Number of the first block without a set bit in ``x``; null if none."""
    out = F.lit(None).cast("int")
    for k, (a, w) in reversed(list(enumerate(_blocks()))):
        mask = ((1 << w) - 1) << a
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        out = F.when(x.bitwiseAND(F.lit(mask).cast("long")) == 0, F.lit(k)).otherwise(out)
    return out


def _spans() -> Column:
    """(low, high) of the starts of all windows of ``len`` shingles with ``need`` of the sorted positions ``hits``.

    A window whose first hit is number j starts behind hit j - 1 (so that no start is
    given twice), not behind hit j, and reaches hit j + need - 1.
    """
    spans = F.expr(
        "transform(slice(hits, 1, size(hits) - need + 1), (p, j) -> struct("
        "greatest(0, get(hits, j - 1) + 1, get(hits, j + need - 1) - len + 1) as low, least(p, n - len) as high))"
    )
    return F.filter(spans, lambda s: s["low"] <= s["high"])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of the numbers of each hash in two arrays; null if both are empty."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    common = F.array_intersect(a, b)
    shared = F.when(plain, F.size(common)).otherwise(
        F.aggregate(common, F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    )
    return F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double"))


def contamination(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, start, length, similarity of every item that a document contains.

    ``start`` and ``length`` give the best window in words (the first of equals);
    documents shorter than an item are one window. Documents and items without
    words match nothing; rows without an id are left out, rows that share a
    doc_id or item_id are one document or item (its best window counts). Other
    columns are ignored. Lower-casing covers A-Z only.
    """
    spark = docs.sparkSession
    bench = staged(
        items.where("item_id is not null")
        .select("item_id", shingles(F.col("text")).alias("wins"))
        .where(F.size("wins") > 0)
        .distinct(),
        "bench",
    )
    small = (bench.agg(F.sum(F.size("wins"))).first()[0] or 0) <= BROADCAST_SHINGLES
    hint = F.broadcast if small else (lambda f: f)
    # The bit set goes into the plan once, as one foldable array.
    bits = F.expr("array(" + ",".join(f"{b}L" if b > -(1 << 63) else "shiftleft(1L, 63)" for b in filter_bits(bench)) + ")")

    def hit(h: Column) -> Column:
        one, two = (
            F.call_function("shiftright", F.get(bits, F.call_function("shiftright", b, F.lit(6)).cast("int")), (b % 64).cast("int"))
            .bitwiseAND(F.lit(1)) == 1
            for b in _places(h)
        )
        return one & two

    split = docs.where("doc_id is not null").select("doc_id", shingles(F.col("text")).alias("wins"))
    near = split.select(
        "doc_id", "wins", F.filter(F.transform("wins", lambda h, i: F.when(hit(h), i)), lambda i: i.isNotNull()).alias("at")
    ).where(F.size("at") > 0)
    near = staged(near.withColumn("row_key", F.xxhash64("wins")), "near")

    shared = bench.select(F.size("wins").alias("m"), F.explode("wins").alias("h")).distinct()
    need = F.ceil(similarity * (F.col("len") + F.col("m")) / (1 + similarity) - 1e-6).cast("int")
    spans = (
        near.select("doc_id", "row_key", F.size("wins").alias("n"), F.explode("at").alias("pos"), "wins")
        .select("doc_id", "row_key", "n", "pos", F.get("wins", F.col("pos")).alias("h"))
        .join(hint(shared), "h")
        .groupBy("doc_id", "row_key", "n", "m")
        .agg(F.array_sort(F.collect_set("pos")).alias("hits"))
        .withColumn("len", F.least("m", "n"))
        .withColumn("need", need)
        .where(F.size("hits") >= F.col("need"))
        .select("doc_id", "row_key", "len", "m", _spans().alias("spans"))
        .where(F.size("spans") > 0)
        .groupBy("doc_id", "row_key")
        .agg(F.collect_list(F.struct("len", "m", "spans")).alias("places"))
    )
    texts = staged(
        spans.join(near.dropDuplicates(["doc_id", "row_key"]).select("doc_id", "row_key", "wins"), ["doc_id", "row_key"]),
        "windows",
    )
    windows = (
        texts.select("doc_id", "row_key", "wins", F.inline("places"))
        .select("doc_id", "row_key", "wins", "len", "m", F.inline("spans"))
        .select("doc_id", "row_key", "wins", "len", "m", F.explode(F.sequence("low", "high")).alias("start"))
    )
    part = F.slice("wins", F.col("start") + 1, F.col("len"))
    keys = ["doc_id", "row_key", "start", "len", "m"]
    prints = fingerprint(windows.select(*keys, F.explode(part).alias("h")), keys)
    bench_prints = fingerprint(bench.select("item_id", F.size("wins").alias("m"), F.explode("wins").alias("h")), ["item_id", "m"])
    left, right = _with_blocks(prints).alias("w"), _with_blocks(bench_prints).alias("i")
    apart = F.col("w.fp").bitwiseXOR(F.col("i.fp"))
    found = left.join(
        hint(right),
        (F.col("w.m") == F.col("i.m"))
        & (F.col("w.block") == F.col("i.block"))
        & (F.col("w.value") == F.col("i.value"))
        & (F.bit_count(apart) <= RADIUS)
        & (_first_equal_block(apart) == F.col("w.block")),
    ).select(*[f"w.{k}" for k in keys], "i.item_id")
    checked = (
        found.join(texts.select("doc_id", "row_key", F.col("wins").alias("text_wins")), ["doc_id", "row_key"])
        .withColumn("shingles", F.slice("text_wins", F.col("start") + 1, F.col("len")))
        .join(hint(bench.select("item_id", F.size("wins").alias("m"), "wins")), ["item_id", "m"])
        .withColumn("similarity", weighted_similarity(F.col("shingles"), F.col("wins")))
        .where(F.col("similarity") >= similarity)
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "len")).alias("b")
    return (
        checked.groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "item_id",
            (-F.col("b.s")).cast("long").alias("start"),
            (F.col("b.len") + SHINGLE - 1).cast("long").alias("length"),
            F.round("b.similarity", 6).alias("similarity"),
        )
    )


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) whose text the document contains."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, items)
