"""Work of one task: partitions that follow the rows, sets without sorts, steps done once."""

import contextlib
import io

from pyspark.sql import functions as F

from sentria import session
from sentria.operators import counts, joins
from sentria.operators.contingency import contingency
from sentria.operators import bayes
from sentria.plans import registry as plans
from sentria.sources import star_views


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def sides(spark):
    drugs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None), (None, "a")], "REPORT_ID long, drug string")
    events = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (3, "x"), (4, "x"), (2, None)], "REPORT_ID long, event string")
    return drugs, events


def test_sets_of_both_sides_need_no_join(spark):
    met = joins.report_cells(*sides(spark), "REPORT_ID", "drug", "event")
    assert sorted(tuple(r) for r in met.collect()) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    assert "Join" not in plan(met)


def test_tasks_follow_the_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    rows = star_views.table(spark, sf_dir, "lineitem").count()
    (drugs,) = star_views.rows_by_report(spark, sf_dir, "report_ingredients")
    assert f"l_orderkey#" in plan(drugs) and f", {-(-rows // 100)}), REPARTITION_BY_NUM" in plan(drugs)
    assert "SortMergeJoin" not in plan(drugs)


def test_counts_of_the_left_joined_fact(spark):
    got = {(r.drug, r.event): r["count"] for r in counts.fact_pair_counts(*sides(spark), "drug", "event").collect()}
    drugs, events = sides(spark)
    fact = drugs.join(events, "REPORT_ID", "left").filter("REPORT_ID IS NOT NULL").distinct()
    assert got == {(r.drug, r.event): r["n"] for r in fact.groupBy("drug", "event").agg(F.count("REPORT_ID").alias("n")).collect()}
    assert got["a", None] == 1


def test_equal_cells_are_drawn_once(spark):
    rows = [(f"d{i}", f"e{i}", 3) for i in range(50)] + [("d50", "e50", 4)]
    ct = contingency(spark.createDataFrame(rows, "drug string, event string, count long"), "drug", "event")
    t = bayes.bcpnn_mc(ct, draws=200, seed=1)
    drawn = plan(t).split("ArrowEvalPython")[1]
    assert "HashAggregate(keys=[n11#" in drawn.split("SortMergeJoin")[0].split("Generate")[0]
    assert t.count() == 51 and t.filter("n11 = 3").select("median_IC", "LB95_IC").distinct().count() == 1


def test_quarters_are_counted_in_one_pass(spark, sf_dir, monkeypatch):
    calls = []
    count = counts.pair_counts_from_tables
    monkeypatch.setattr(plans.counts, "pair_counts_from_tables", lambda *a, **b: calls.append(1) or count(*a, **b))
    plans.registry()["a3_quarters_loaded"](spark, sf_dir)
    assert len(calls) == 1


def test_names_of_nested_rows_are_not_moved(spark, sf_dir):
    for t in star_views.rows_by_report(spark, sf_dir, "doc_drugs", "doc_reactions"):
        text = plan(t.groupBy("REPORT_ID").agg(F.collect_list(t.columns[1])))
        assert text.count("Exchange hashpartitioning(l_orderkey") == 1 and "hashpartitioning(REPORT_ID" not in text


def test_pairs_are_formed_in_tasks_that_follow_the_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    tasks = -(-star_views.table(spark, sf_dir, "lineitem").count() // 100)
    formed = [plans._pt_counts(spark, sf_dir), plans._cohort_counts(spark, sf_dir, "HLT", by="quarter"), plans._cohort_rows(spark, sf_dir)]
    for t in formed:
        dealt = [line for line in plan(t).splitlines() if "_row#" in line and "hashpartitioning" in line]
        assert len(dealt) == 1 and f", {tasks}), REPARTITION_BY_NUM" in dealt[0]


def test_number_of_tasks_does_not_change_the_pairs(spark):
    met = [sorted(tuple(r) for r in joins.report_cells(*sides(spark), "REPORT_ID", "drug", "event", tasks=n).collect()) for n in (1, 500)]
    assert met[0] == met[1] == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
