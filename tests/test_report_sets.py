"""Report sets against sets of numbers, and panels that read a stored set only."""

import random

import pytest
from pyspark.sql import functions as F

from sentria.operators import report_sets, search
from sentria.operators.report_sets import ReportSet


def _ids(spark, values, kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"REPORT_ID {kind}")


def _members(s):
    found = [r[0] for r in s.members().collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed", range(3))
def test_sets_and_their_combinations(spark, seed):
    rng = random.Random(seed)
    edge = [0, 1, 63, 64, 65, -1, -64, -65, 2**62, 2**63 - 1, -(2**63)]
    draw = lambda: {rng.randrange(-300, 300) for _ in range(150)} | set(rng.sample(edge, 6))
    a, b = draw(), draw()
    x, y = ReportSet.of(_ids(spark, [*a, *a, None])), ReportSet.of(_ids(spark, b)).stored()
    assert _members(x) == a and _members(x & y) == a & b and _members(x | y) == a | b and _members(x - y) == a - b
    assert (x & y).count().head().n_reports == len(a & b)
    rows = _ids(spark, [*range(-310, 310), *edge, None, 5, 5]).withColumn("k", F.monotonically_increasing_id())
    assert sorted(r.REPORT_ID for r in x.of_rows(rows).collect()) == sorted(v for v in [*range(-310, 310), *edge, 5, 5] if v in a)


def test_empty_sets_and_other_columns(spark):
    none, some = ReportSet.of(_ids(spark, [])), ReportSet.of(_ids(spark, [7, 8], "int"))
    assert none.is_empty() and none.count().head().n_reports == 0 and (none & some).is_empty() and (some - some).is_empty()
    assert _members(some - none) == {7, 8} and _members(none | some) == {7, 8}
    named = ReportSet.of(_ids(spark, [3]).withColumnRenamed("REPORT_ID", "case"), "case")
    assert named.members().columns == ["case"] and named.of_rows(spark.range(9).withColumnRenamed("id", "case")).count() == 1


@pytest.fixture(scope="module")
def tables(spark):
    reports = spark.range(500).select(
        F.col("id").alias("REPORT_ID"), F.lit("Yes").alias("SERIOUSNESS_ENG"), F.lit(None).cast("int").alias("DEATH"),
        F.when(F.col("id") % 2 == 0, "Male").otherwise("Female").alias("GENDER_ENG"), (F.col("id") % 90).cast("double").alias("AGE_Y"),
    )
    drugs = spark.range(900).select((F.col("id") % 450).alias("REPORT_ID"), F.concat(F.lit("d"), F.col("id") % 7).alias("DRUGNAME"), F.lit("Suspect").alias("DRUGINVOLV_ENG"))
    reactions = spark.range(900).select((F.col("id") % 300).alias("REPORT_ID"), F.concat(F.lit("e"), F.col("id") % 5).alias("PT_NAME_ENG"), F.lit(None).cast("string").alias("SMQ"), F.lit("S").alias("SOC_NAME_ENG"))
    return search.Tables(reports, drugs, reactions)


@pytest.mark.parametrize("query", [search.Query(), search.Query(gender="Male", brands=("d1", "d4")), search.Query(reactions=("e3",), age=(20, 40)), search.Query(brands=("nothing",))])
def test_a_search_as_a_set(tables, query):
    want = {r.REPORT_ID for r in search.search_reports(tables, query).collect()}
    assert _members(report_sets.search_set(tables, query)) == want


def test_panels_read_the_stored_set_only(spark, tables, tmp_path):
    for name in ("reports", "drugs", "reactions"):
        getattr(tables, name).write.parquet(str(tmp_path / name))
    stored = search.Tables(*[spark.read.parquet(str(tmp_path / n)) for n in ("reports", "drugs", "reactions")])
    found = report_sets.search_set(stored, search.Query(gender="Male", brands=("d1",))).stored()
    want = {r.REPORT_ID for r in search.search_reports(tables, search.Query(gender="Male", brands=("d1",))).collect()}
    for k in range(10):
        panel = found.of_rows(stored.reactions).groupBy("PT_NAME_ENG").agg(F.count(F.lit(k)).alias("n"))
        plan = panel._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan") == 1 and "DRUGNAME" not in plan and "GENDER_ENG" not in plan
    total = sum(r.n for r in panel.collect())
    assert total == tables.reactions.filter(F.col("REPORT_ID").isin(list(want))).count()
