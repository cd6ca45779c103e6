"""The quarter store against counts of all quarters at once, and large reports cut into cells."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sentria.operators import counts, joins
from sentria.operators.contingency import contingency
from sentria.plans.quarter_store import QuarterStore
from sentria.plans.signals import cumulative_contingency, cumulative_ic, signals_from_counts


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(5)
    # A drug that comes late, a pair that stays away, a quarter with a single pair.
    rows = {(q, f"d{rng.randrange(4)}", f"e{rng.randrange(5)}"): rng.randrange(1, 40) for q in (20061, 20062, 20064, 20071) for _ in range(12)}
    rows |= {(20062, "early", "e0"): 3, (20071, "late", "e9"): 2, (20072, "d0", "e0"): 1}
    return spark.createDataFrame([(*k, n) for k, n in rows.items()], "quarter long, ing string, PT_NAME_ENG string, count long")


def _rows(t):
    return sorted(repr(tuple(r)) for r in t.collect())


def _loaded(spark, pairs, root, compact_after=None):
    store = QuarterStore(spark, str(root))
    for q in (20061, 20062, 20064, 20071, 20072):
        assert store.load(pairs.filter(F.col("quarter") == q), "ing", "PT_NAME_ENG") == [q]
        if q == compact_after:
            store.compact()
    return store


@pytest.mark.parametrize("compact_after", [None, 20062])
def test_quarters_one_by_one(spark, pairs, tmp_path, compact_after):
    store = _loaded(spark, pairs, tmp_path, compact_after)
    assert store.quarters() == [20061, 20062, 20064, 20071, 20072]
    assert _rows(store.pairs()) == _rows(pairs)
    once = contingency(pairs, "ing", "PT_NAME_ENG", by=["quarter"])
    assert _rows(store.contingency()) == _rows(once)
    running = cumulative_contingency(pairs, "ing", "PT_NAME_ENG")
    assert _rows(store.cumulative_contingency()) == _rows(running)
    keys = pairs.select("quarter", F.col("ing").alias("drug_code"), F.col("PT_NAME_ENG").alias("event_effect"))
    assert _rows(store.changed()) == _rows(running.join(keys, keys.columns, "left_semi"))


def test_a_history_and_then_a_quarter(spark, pairs, tmp_path):
    store = QuarterStore(spark, str(tmp_path))
    assert store.load(pairs.limit(0), "ing", "PT_NAME_ENG") == [] and store.quarters() == []
    with pytest.raises(ValueError):
        store.pairs()
    store.load(pairs.filter("quarter < 20072"), "ing", "PT_NAME_ENG")
    assert store.score(exact=False) == [20061, 20062, 20064, 20071]
    store.load(pairs.filter("quarter = 20072"), "ing", "PT_NAME_ENG")
    assert store.score(exact=False) == [20072] and store.score(exact=False) == []
    once = cumulative_ic(signals_from_counts(pairs, "ing", "PT_NAME_ENG", by="quarter", exact=False, ordered=False))
    columns = ["quarter", "drug_code", "event_effect", "count", "PRR", "median_IC", "IC_cumulative", "LB95_IC_cumulative"]
    rounded = lambda t: _rows(t.select(*columns[:4], *[F.round(c, 9) for c in columns[4:]]))
    assert rounded(store.scores()) == rounded(once)
    assert store.scores([20072]).count() == 1


def test_earlier_quarters_are_refused(spark, pairs, tmp_path):
    store = QuarterStore(spark, str(tmp_path))
    store.load(pairs.filter("quarter = 20064"), "ing", "PT_NAME_ENG")
    for again in (20064, 20061):
        with pytest.raises(ValueError):
            store.load(pairs.filter(F.col("quarter") == again), "ing", "PT_NAME_ENG")


def test_a_broken_load_is_invisible_and_repeated(spark, pairs, tmp_path):
    store = QuarterStore(spark, str(tmp_path))
    store.load(pairs.filter("quarter = 20061"), "ing", "PT_NAME_ENG")
    # A load that stopped before its mark leaves rows that nobody sees.
    left = store._counts().withColumns({"quarter": F.lit(20062).cast("long"), "n": F.col("n") * 7})
    store._write(left, "counts")
    assert store.quarters() == [20061] and store.pairs().select("quarter").distinct().count() == 1
    store.load(pairs.filter("quarter = 20062"), "ing", "PT_NAME_ENG")
    assert _rows(store.pairs()) == _rows(pairs.filter("quarter < 20063"))


def test_only_the_partition_of_a_quarter_is_read(spark, pairs, tmp_path):
    store = _loaded(spark, pairs, tmp_path)
    for t in (store.contingency([20071]), store.changed([20071]), store.pairs([20071])):
        scans = re.findall(r"FileScan.*", t._jdf.queryExecution().sparkPlan().toString())
        assert scans and all(re.search(r"PartitionFilters: \[.*20071", s) and "20062" not in s for s in scans)


def test_keys_without_text_fall_out(spark, tmp_path):
    t = spark.createDataFrame([(20061, None, "e", 2), (20061, "d", None, 3), (None, "d", "e", 4), (20061, "d", "e", 5)], "quarter long, d string, e string, count long")
    store = QuarterStore(spark, str(tmp_path))
    store.load(t, "d", "e")
    assert _rows(store.contingency()) == [repr((20061, "d", "e", 5, 5, 5, 5))]


# Large reports


def test_one_large_report_is_spread(spark):
    n = 400
    drugs = spark.range(n).select(F.lit(1).alias("REPORT_ID"), F.concat(F.lit("d"), "id").alias("d"))
    drugs = drugs.unionByName(drugs).unionByName(spark.createDataFrame([(2, "d0"), (3, None), (None, "d1"), (4, "d5")], "REPORT_ID int, d string"))
    events = spark.range(n).select(F.lit(1).alias("REPORT_ID"), F.concat(F.lit("e"), "id").alias("e"))
    events = events.unionByName(spark.createDataFrame([(2, "e0"), (2, "e0"), (2, "e1"), (3, "e0"), (5, "e0")], "REPORT_ID int, e string"))
    met = joins.report_cells(drugs, events, "REPORT_ID", "d", "e", limit=2_500).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in met.groupBy("task").count().collect()]
    assert sum(sizes) == n * n + 2 and len(sizes) >= 8 and max(sizes) < 0.35 * n * n
    got = counts.pair_counts_from_tables(drugs, events, "d", "e", cell_pairs=2_500)
    assert got.count() == n * n and got.filter("count <> 1").collect()[0].asDict() == {"d": "d0", "e": "e0", "count": 2}


@pytest.mark.parametrize("cell_pairs", [1, 9, 1_000_000])
def test_counts_and_rows_of_cells(spark, cell_pairs):
    rng = random.Random(3)
    left = [(r, 20060 + r % 3, rng.choice(["a", "b", "c", None])) for r in range(60) for _ in range(rng.randrange(5))]
    right = [(r, rng.choice(["x", "y", None])) for r in range(60) for _ in range(rng.randrange(4))]
    drugs = spark.createDataFrame(left, "REPORT_ID long, quarter long, d string")
    events = spark.createDataFrame(right, "REPORT_ID long, e string")
    rows = Counter((d, e, q) for r, q, d in left for r2, e in right if r == r2 and d and e)
    reports = Counter((d, e, q) for _, q, d, e in {(r, q, d, e) for r, q, d in left for r2, e in right if r == r2 and d and e})
    got = counts.pair_rows_from_tables(drugs, events, "d", "e", cell_pairs=cell_pairs)
    assert {(r.d, r.e, r.quarter): (r["count"], r.n) for r in got.collect()} == {k: (reports[k], rows[k]) for k in rows}
    by = counts.pair_counts_from_tables(drugs, events, "d", "e", by="quarter", cell_pairs=cell_pairs)
    assert {(r.d, r.e, r.quarter): r["count"] for r in by.collect()} == reports
