"""Search, series, lists, nested documents and files on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentria.operators import joins, nested, search, summaries, vocab
from sentria.operators.counts import analysis_cohort
from sentria.plans.registry import registry
from sentria.session import new_shared_path
from sentria.sources import extract, snapshots
from sentria.sources.nested import NESTED_SCHEMA, read_nested_reports


def ids(t):
    return sorted(r[0] for r in t.collect())


def dated(spark, *days):
    return spark.createDataFrame([(i, d) for i, d in enumerate(days)], "REPORT_ID int, DATINTRECEIVED_CLEAN date")


def test_period_ends_on_day_one_of_the_last_month(spark):
    t = dated(spark, dt.date(2000, 1, 1), dt.date(2000, 3, 1), dt.date(2000, 3, 2), dt.date(1999, 12, 31))
    lo, hi = dt.date(2000, 1, 20), dt.date(2000, 3, 15)
    assert ids(t.filter(search.in_period(lo, hi)).select("REPORT_ID")) == [0, 1]
    assert ids(t.filter(search.in_period(lo, hi, whole_months=True)).select("REPORT_ID")) == [0, 1, 2]


def test_equal_months_move_the_end_by_one_day(spark):
    t = dated(spark, dt.date(2000, 3, 1), dt.date(2000, 4, 1))
    assert ids(t.filter(search.in_period(dt.date(2000, 3, 1), dt.date(2000, 3, 30))).select("REPORT_ID")) == [0]
    assert ids(t.filter(search.in_period(dt.date(2000, 3, 1), dt.date(2000, 3, 31))).select("REPORT_ID")) == [0, 1]


def test_null_ages_never_match(spark):
    t = spark.createDataFrame([(1, None), (2, 0.0), (3, 100.0), (4, 101.0)], "REPORT_ID int, AGE_Y double")
    assert ids(t.filter(search.age_between())) == [2, 3]
    assert ids(t.filter(search.age_between(0, 100, open_top=True))) == [2, 3, 4]
    assert ids(t.filter(search.age_between(0, 90, open_top=True))) == [2]


def test_search_needs_a_drug_and_a_reaction_but_not_together(spark):
    reports = spark.createDataFrame(
        [(i, dt.date(2000, 1, 1), "Yes", 2 if i < 3 else 1, "Male", 30.0) for i in range(1, 5)],
        "REPORT_ID int, DATINTRECEIVED_CLEAN date, SERIOUSNESS_ENG string, DEATH int, GENDER_ENG string, AGE_Y double",
    )
    drugs = spark.createDataFrame([(1, 7, "A", "Suspect"), (2, 8, "B", "Suspect"), (3, 7, "A", "Concomitant")],
                                  "REPORT_ID int, DRUG_PRODUCT_ID int, DRUGNAME string, DRUGINVOLV_ENG string")
    rxn = spark.createDataFrame([(1, "Rash", None, "Skin"), (2, "", None, "Skin"), (3, "Itch", "S1", "Skin")],
                                "REPORT_ID int, PT_NAME_ENG string, SMQ string, SOC_NAME_ENG string")
    ingredients = spark.createDataFrame([(7, "alpha"), (7, "beta")], "DRUG_PRODUCT_ID int, ACTIVE_INGREDIENT_NAME string")
    tables = search.Tables(reports, drugs, rxn, ingredients)

    def found(**kw):
        return ids(search.search_reports(tables, search.Query(**kw)))

    assert found() == [1, 3]
    assert found(ingredients=["alpha", "beta"]) == [1, 3]
    assert found(seriousness="Death") == [3]
    assert found(seriousness=search.SERIOUS_NO_DEATH) == [1]
    assert found(reactions=["S1"]) == [3] and found(involvement="Suspect") == [1]
    assert found(brands=["B"]) == [] and found(gender="Both") == [1, 3]
    nothing = search.search_reports(tables, search.Query(brands=["B"]))
    assert search.is_empty(nothing) and search.restrict(drugs, nothing).count() == 3
    assert search.restrict(drugs, nothing, empty_means_all=False).count() == 0


def series_of(spark, *days):
    t = spark.createDataFrame([(d, "No", None) for d in days], "DATINTRECEIVED_CLEAN date, SERIOUSNESS_ENG string, DEATH int")
    return {r.time_p: r.nonserious for r in summaries.report_series(t).collect()}


def test_series_keeps_the_last_bucket_and_switches_at_730_days(spark):
    assert series_of(spark, dt.date(2001, 1, 15), dt.date(2001, 2, 10)) == {dt.date(2001, 1, 1): 1, dt.date(2001, 2, 1): 1}
    gap = series_of(spark, dt.date(2001, 1, 15), dt.date(2001, 3, 10))
    assert gap[dt.date(2001, 2, 1)] == 0
    start = dt.date(2001, 1, 1)
    assert len(series_of(spark, start, start + dt.timedelta(729))) == 24
    assert len(series_of(spark, start, start + dt.timedelta(730))) == 3


def test_ties_are_broken_by_label_and_empty_lists_have_a_none_row(spark):
    t = spark.createDataFrame([(i, f"D{i:02}", "Suspect") for i in range(30)], "REPORT_ID int, DRUGNAME string, DRUGINVOLV_ENG string")
    assert [r.DRUGNAME for r in summaries.top_drugs(t).collect()] == [f"D{i:02}" for i in range(25)]
    assert [tuple(r) for r in summaries.top_drugs(t, "Concomitant").collect()] == [("None", 0)]
    none = t.withColumn("INDICATION_NAME_ENG", F.lit(None).cast("string"))
    assert [tuple(r) for r in summaries.top_indications(none).collect()] == [("None", 0)]


def test_age_histogram_bins_are_right_closed(spark):
    t = spark.createDataFrame([(a,) for a in (0.0, 2.0, 2.01, 100.0, 100.5, None)], "AGE_Y double")
    got = {(r.bin_lo, r.bin_hi): r.n for r in summaries.age_histogram(t).collect() if r.age_group != "Neonate"}
    assert got == {(0, 2): 1, (2, 4): 1, (98, 100): 1}
    assert summaries.age_excluded(t).head().n == 1


def test_vocabulary_leaves_out_names_that_are_no_text(spark):
    t = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",), ("",), (" \t",), ("d\x01e",), (" f g",)], "x string")
    assert [r.term for r in vocab.vocabulary(t, "x", clean=True).collect()] == [" f g", "a", "b", "c"]
    assert [r.term for r in vocab.vocabulary(t, "x").collect()] == ["", " \t", " f g", "a", "b", "c", "d\x01e"]


def test_merge_series(spark):
    a = spark.createDataFrame([(1, 5), (2, 1), (2, 2)], "time_p int, n long")
    b = spark.createDataFrame([(2, 7), (None, 3)], "time_p int, n long")
    got = {r.time_p: (r.a, r.b) for r in joins.merge_series({"a": a, "b": b}).collect()}
    assert got == {1: (5, 0), 2: (3, 7), None: (0, 3)}
    assert joins.merge_series({"a": a.limit(0), "b": b.limit(0)}).count() == 0


def test_filled_calendar_counts_all_orders(spark, tmp_path):
    days = [dt.datetime(2000, 1, 5), dt.datetime(2000, 1, 9), dt.datetime(2000, 4, 2)]
    t = spark.createDataFrame([(i, 7 + i, d) for i, d in enumerate(days)], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    t.write.parquet(f"{tmp_path}/orders.parquet")
    got = {str(r.time_p): r.n for r in registry()["j8_fill_calendar"](spark, str(tmp_path)).collect()}
    assert got == {"2000-01-01": 2, "2000-02-01": 0, "2000-03-01": 0, "2000-04-01": 1}


def test_fill_calendar_fills_gaps(spark):
    t = spark.sql("SELECT * FROM VALUES (DATE '2001-11-01', 2L), (DATE '2002-02-01', 1L) AS t(time_p, n)")
    got = {str(r.time_p): r.n for r in summaries.fill_calendar(t, "time_p", "month").collect()}
    assert got == {"2001-11-01": 2, "2001-12-01": 0, "2002-01-01": 0, "2002-02-01": 1}


def test_coverage_and_stacking(spark):
    names = spark.createDataFrame([("a",), ("B",), ("z",)], "ing string")
    one, two = spark.createDataFrame([("A",)], "x string"), spark.createDataFrame([("b",)], "y string")
    assert {r.ing: r.found for r in joins.coverage(names, {"one": one, "two": two}).collect()} == {"a": True, "B": True, "z": False}
    keyed = joins.semi_keys(names, one.select(F.lower("x").alias("x")), {"ing": "x"})
    assert ids(keyed) == ["a"]


def test_densify_fills_absent_quarters(spark):
    counts = spark.createDataFrame([("A", 20061, 2), ("A", 20063, 1), ("B", 20062, 5)], "ing string, quarter long, n long")
    pairs = spark.createDataFrame([("A",)], "ing string")
    out = joins.densify(pairs, counts.select("quarter"), counts, ["ing"])
    assert sorted((r.quarter, r.n) for r in out.collect()) == [(20061, 2), (20062, 0), (20063, 1)]


def test_cohort_cut_prunes_partitions(spark):
    root = new_shared_path(spark, "prune")
    fact = spark.createDataFrame([(1, "a", 20054), (2, "b", 20061), (3, None, 20062)], "REPORT_ID int, PT_NAME_ENG string, quarter long")
    snapshots.write_snapshot(fact, root, "fact", "20160630", partition_by=("quarter",))
    back = analysis_cohort(snapshots.open_snapshot(spark, root, "fact", "20160630"), 20061)
    assert ids(back.select("REPORT_ID")) == [2]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quarter" in plan
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        snapshots.write_snapshot(fact, root, "fact", "20160630")


def test_extract_lines_are_stripped_filled_and_unquoted(spark, tmp_path):
    (tmp_path / "r.txt").write_text('1$ Rash $3.5$x\n2$"a$b"$$NA\n3$short\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType()),
                           T.StructField("v", T.DoubleType()), T.StructField("u", T.StringType())])
    rows = [tuple(r) for r in extract.read_extract(spark, str(tmp_path), {"r": schema})["r"].orderBy("id").collect()]
    assert rows == [(1, "Rash", 3.5, "x"), (2, "a$b", None, None), (3, "short", None, "")]


def test_hierarchy_file_keeps_quotes(spark, tmp_path):
    (tmp_path / "h.asc").write_text('1$2$3$4$Crohn"s # x$H$G$S$Ab$$4$Y$\n')
    row = extract.read_hierarchy(spark, str(tmp_path / "h.asc"), "v.1").head()
    assert (row.PT_Term, row.Primary_PT_SOC, row.Primary_SOC_flag, row.MEDDRA_VERSION) == ('Crohn"s # x', 4, "Y", "v.1")
    assert len(row) == 12


def test_csv_export_keeps_the_tab(spark):
    path = new_shared_path(spark, "csv")
    t = spark.createDataFrame([(7, "x,y", None)], "REPORT_ID int, A string, B string")
    snapshots.export_csv(t.coalesce(1), ["REPORT_ID", "A", "B"], path)
    text = [r.value for r in spark.read.text(path).collect()]
    assert text[0] == "REPORT_ID,A,B" and text[1].replace('"', "") == "\t000000007,x,y,NA"


def test_nested_search_and_missing_arrays(spark):
    def doc(day, generics, terms, age=None, unit=None):
        drug = None if generics is None else [(None, ([g], None, None)) if g else ("pain", None) for g in generics]
        reaction = None if terms is None else [(t, 1) for t in terms]
        return (day, None, 1, (None,) * 6, (None,), (1, age, unit, drug, reaction))

    docs = spark.createDataFrame(
        [doc(dt.date(2000, 1, 1), ["A", None, "A"], ["x", "x", "y"], 5.0, "800"),
         doc(dt.date(2000, 1, 31), ["B"], ["x"], 5.0, None), doc(dt.date(2000, 3, 1), None, None)], NESTED_SCHEMA)
    assert {r.term: r.n for r in nested.nested_counts(docs, nested.GENERIC).collect()} == {"A": 1, "B": 1}
    assert {r.term: r.n for r in nested.nested_counts(docs, nested.REACTION).collect()} == {"x": 2, "y": 1}
    found = nested.search_nested(docs, dt.date(2000, 1, 1), dt.date(2000, 1, 31), generics=["A", "Z"], reactions=["y"])
    assert found.count() == 1
    assert {r.month: r.total for r in nested.nested_series(docs).collect()}[dt.date(2000, 2, 1)] == 0
    assert {(r.age, r.age_group): r.n for r in nested.nested_ages(docs).collect()} == {(50.0, "Adult"): 1, (None, "Not reported"): 1}
    path = new_shared_path(spark, "docs")
    docs.write.json(path)
    assert sorted(map(repr, read_nested_reports(spark, path).collect())) == sorted(map(repr, docs.collect()))


def test_nested_rollup_keeps_ties(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None, (None, None, None, None, [(t, 1)])) for t in ("a", "b", "c", "c")], NESTED_SCHEMA)
    h = spark.createDataFrame([("A", "H1", "Y"), ("B", "H2", "Y"), ("C", "H3", "Y"), ("C", "H1", "N")],
                              "PT_Term string, HLT_Term string, Primary_SOC_flag string")
    assert {r.HLT_Term: r.n for r in nested.nested_top_hlt(docs, h, 1).collect()} == {"H3": 2}
    assert len(nested.nested_top_hlt(docs, h, 2).collect()) == 3


def test_hierarchy_join_keeps_unmatched_and_primary_rows_only(spark):
    fact = spark.createDataFrame([(1, "p", "v1"), (2, "q", "v1")], "REPORT_ID int, PT_NAME_ENG string, MEDDRA_VERSION string")
    h = spark.createDataFrame([("p", "H", "G", "Y", "v1"), ("p", "H2", "G2", "N", "v1"), ("q", "H", "G", "Y", "v2")],
                              "PT_Term string, HLT_Term string, HLGT_Term string, Primary_SOC_flag string, MEDDRA_VERSION string")
    got = {r.REPORT_ID: r.HLT_NAME_ENG for r in joins.add_hierarchy(fact, h).collect()}
    assert got == {1: "H", 2: None}
