"""Tables stored by quarter and report: same rows, and plans without an exchange where the report decides."""

import re

import pytest
from pyspark.sql import functions as F

from sentria.sources.stored_fact import distinct_reports, open_stored, write_stored


@pytest.fixture(scope="module")
def rows(spark):
    t = spark.range(600).select(
        (F.col("id") % 150).alias("REPORT_ID"),
        F.concat(F.lit("d"), F.col("id") % 7).alias("ing"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("e"), F.col("id") % 5)).alias("PT"),
        (20061 + F.col("id") % 150 % 3).alias("quarter"),
    )
    return t.unionByName(t.limit(50)).unionByName(t.limit(1).withColumn("REPORT_ID", F.lit(None).cast("long")))


def _sorted(t):
    return sorted(map(repr, t.collect()))


def _plan(t):
    """The plan as it stands before it runs."""
    t = t.select("*")
    return t._jdf.queryExecution().sparkPlan().toString(), t._jdf.queryExecution().executedPlan().toString()


def test_counts_and_joins_need_no_exchange_on_the_report(spark, rows, tmp_path):
    columns = rows.columns
    stored = write_stored(rows, str(tmp_path / "fact"), 4)
    assert _sorted(stored.select(*columns)) == _sorted(rows)
    got = distinct_reports(stored, ["ing", "PT"])
    assert _sorted(got) == _sorted(rows.na.drop().groupBy("ing", "PT").agg(F.countDistinct("REPORT_ID").alias("count")))
    plan = _plan(got)[1]
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("partial_count")
    other = write_stored(rows.select("REPORT_ID", "quarter").distinct(), str(tmp_path / "ids"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = stored.join(other.filter("quarter = 20062"), "REPORT_ID", "left_semi")
        assert "Exchange" not in _plan(joined)[1]
        assert joined.count() == rows.filter("quarter = 20062").na.drop(subset=["REPORT_ID"]).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_cohort_reads_its_quarters(spark, rows, tmp_path):
    stored = write_stored(rows, str(tmp_path / "fact"), 4).filter(F.col("quarter") >= 20062)
    assert re.search(r"PartitionFilters: \[[^\]]*20062", _plan(stored)[0])
    assert all("quarter=20061" not in f for f in stored.inputFiles())


def test_opened_again(spark, rows, tmp_path):
    path = str(tmp_path / "fact")
    first = write_stored(rows, path, 4)
    name = first._jdf.queryExecution().analyzed().toString()
    spark.sql(f"DROP TABLE {re.search('stored_[0-9a-f]{24}', name).group()}")
    again = open_stored(spark, path, 4)
    assert _sorted(again.select(*rows.columns)) == _sorted(rows)
    assert _plan(distinct_reports(again, ["ing"]))[1].count("Exchange") == 1
    with pytest.raises(Exception):
        write_stored(rows, path, 4)


def test_without_quarter_and_without_rows(spark, rows, tmp_path):
    plain = write_stored(rows.drop("quarter"), str(tmp_path / "plain"), 3, by=None)
    assert plain.count() == rows.count()
    assert write_stored(rows.limit(0), str(tmp_path / "none"), 3).count() == 0
