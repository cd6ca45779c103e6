"""Every operator as a query over the star-schema test tables.

Keys carry the operator ids of the project survey. Each callable takes a session
and a data folder and returns a DataFrame over the whole tables.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.functions import cleaning as c
from sentria.operators import (
    bayes,
    contingency as ctg,
    counts,
    disproportionality as disp,
    joins,
    nested,
    ranking,
    report_sets,
    search,
    series,
    shrinkage,
    summaries,
    vocab,
)
from sentria.plans import quarter_store
from sentria.plans import signals as plans
from sentria.session import cut_lineage, new_shared_path
from sentria.sources import extract, snapshots, stored_fact
from sentria.sources import nested as nested_source
from sentria.sources.star_views import report_tasks, rows_by_report, table, view

Query = Callable[[SparkSession, str], DataFrame]

SINCE = 19961  # cohort cut of the test data, 1996 Q1
PERIOD = (dt.date(1996, 3, 15), dt.date(1999, 9, 30))
SAME_MONTH = (dt.date(1997, 6, 10), dt.date(1999, 6, 30))
BRANDS = ("Brand#2 ECONOMY", "Brand#17 ECONOMY", "Brand#9 STANDARD")
INGREDIENTS = ("Brand#3", "Brand#12")
TERMS = ("Supplier#000000004", "Supplier#000000027", "SMQ 0")
SOCS = ("ASIA", "EUROPE")
DRUGS = ("Brand#5", "Brand#6", "Brand#20")
HLTS = ("NATION_3", "NATION_11")
MARGIN = 1700  # removes a third of the pairs at scale factor 0.01
# Fixed prior of the shrinkage queries that have an SQL check.
PRIOR = shrinkage.GammaMixture(alpha1=3.0, beta1=2.5, alpha2=40.0, beta2=41.0, w=0.3)
REPORT_EXPORT_COLUMNS = ("REPORT_ID", "REPORT_NO", "DATINTRECEIVED_CLEAN", "GENDER_ENG", "AGE_Y", "OUTCOME_ENG")

_REGISTRY: dict[str, Query] = {}


def _query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn

    return add


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _r4(t: DataFrame) -> DataFrame:
    return c.round_numeric(t, 4)


def _long(t: DataFrame, *columns: str) -> DataFrame:
    return t.withColumns({name: F.col(name).cast("long") for name in columns})


def _tables(spark: SparkSession, sf: str) -> search.Tables:
    return search.Tables(
        *[view(spark, sf, v) for v in ("reports", "report_drug", "reactions", "drug_ingredients", "substances")]
    )


def _cohort(spark: SparkSession, sf: str) -> DataFrame:
    return counts.analysis_cohort(view(spark, sf, "fact"), SINCE)


def _pt_counts(spark: SparkSession, sf: str) -> DataFrame:
    tasks = report_tasks(spark, sf)
    sides = rows_by_report(spark, sf, "report_drug", "reactions", tasks=tasks)
    return counts.pair_counts_from_tables(*sides, "DRUGNAME", "PT_NAME_ENG", tasks=tasks)


def _pt_ct(spark: SparkSession, sf: str) -> DataFrame:
    return ctg.contingency(_pt_counts(spark, sf), "DRUGNAME", "PT_NAME_ENG")


def _buckets(spark: SparkSession) -> int:
    """Buckets of a stored table: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _cohort_sides(spark: SparkSession, sf: str, tasks: int) -> tuple[DataFrame, DataFrame]:
    """The cohort's report x ingredient and report x reaction rows."""
    sides = rows_by_report(spark, sf, "report_ingredients", "report_terms", tasks=tasks)
    drugs, terms = (t.filter(F.col("quarter") >= SINCE) for t in sides)
    return drugs, terms.filter(F.col("PT_NAME_ENG").isNotNull())


def _cohort_counts(spark: SparkSession, sf: str, level: str = "PT", by: str | None = None) -> DataFrame:
    """Distinct reports per pair of the cohort, from the two sides of the fact."""
    tasks = report_tasks(spark, sf)
    return counts.pair_counts_from_tables(*_cohort_sides(spark, sf, tasks), "ing", counts.level_column(level), by=by, tasks=tasks)


def _cohort_rows(spark: SparkSession, sf: str, level: str = "PT") -> DataFrame:
    """Fact rows per pair and quarter of the cohort, from the two sides of the fact."""
    tasks = report_tasks(spark, sf)
    return counts.pair_rows_from_tables(*_cohort_sides(spark, sf, tasks), "ing", counts.level_column(level), tasks=tasks)


def _hlt_ct(spark: SparkSession, sf: str) -> DataFrame:
    return ctg.contingency(_cohort_counts(spark, sf, "HLT"), "ing", "HLT_NAME_ENG")


# --- sources and sinks -------------------------------------------------------


def _extract_schema(*names: str):
    from pyspark.sql import types as T

    kinds = {"REPORT_ID": T.LongType(), "AGE_Y": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])


@_query("s1_read_extract")
def _s1(spark, sf):
    names = ("REPORT_ID", "DATINTRECEIVED", "GENDER_ENG", "AGE_Y", "OUTCOME_ENG")
    folder = new_shared_path(spark, "extract")
    source = view(spark, sf, "reports").select(*names)
    source.write.option("sep", "$").option("emptyValue", "").csv(f"{folder}/reports.txt")
    return extract.read_extract(spark, folder, {"reports": _extract_schema(*names)})["reports"]


@_query("s1_read_quoted_extract")
def _s1b(spark, sf):
    # Notes of two lines with quotes and separators inside.
    note = F.concat(F.lit('"'), "OUTCOME_ENG", F.lit('"\n'), "GENDER_ENG", F.lit("$"))
    folder = new_shared_path(spark, "extract")
    source = view(spark, sf, "reports").select("REPORT_ID", note.alias("NOTE"), "AGE_Y")
    source.write.option("sep", "$").option("escape", '"').option("emptyValue", "").csv(f"{folder}/notes.txt")
    return extract.read_extract(spark, folder, {"notes": _extract_schema("REPORT_ID", "NOTE", "AGE_Y")}, multi_line=True)["notes"]


@_query("s2_read_hierarchy")
def _s2(spark, sf):
    path = new_shared_path(spark, "hierarchy")
    h = view(spark, sf, "hierarchy").filter("MEDDRA_VERSION = 'v.19.0'")
    first = ["PT_Code", "HLT_Code", "HLGT_Code", "SOC_Code", "PT_Term", "HLT_Term", "HLGT_Term", "SOC_Term", "SOC_Abbrev"]
    positional = h.select(*first, F.lit("").alias("x10"), "Primary_PT_SOC", "Primary_SOC_flag", F.lit("").alias("x13"))
    positional.write.option("sep", "$").option("emptyValue", "").csv(path)
    return extract.read_hierarchy(spark, path, "v.19.0")


@_query("s3_s4_snapshot")
def _s34(spark, sf):
    root = new_shared_path(spark, "snapshots")
    snapshots.write_snapshot(view(spark, sf, "reactions"), root, "reactions", "20160630")
    return snapshots.open_snapshot(spark, root, "reactions", "20160630")


@_query("s5_write_stats")
def _s5(spark, sf):
    path = new_shared_path(spark, "stats")
    snapshots.write_stats(disp.rrr(disp.cells(_hlt_ct(spark, sf))), path)
    return _r4(spark.read.parquet(path).select("drug_code", "event_effect", "n11", "RRR"))


def _exported(name: str, columns: tuple[str, ...]) -> Query:
    """A CSV export, written and read back as text, the age as a number."""

    def run(spark, sf):
        path = new_shared_path(spark, f"export-{name}")
        snapshots.export_csv(view(spark, sf, name), columns, path)
        read = spark.read.option("header", True).option("nullValue", "NA").option("escape", '"')
        kinds = {"AGE_Y": "double"}
        return read.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns)).csv(path)

    return run


_query("s6_export_reports")(_exported("reports", REPORT_EXPORT_COLUMNS))
_query("s6_export_drugs")(_exported("report_drug", ("REPORT_ID", "REPORT_DRUG_ID", "DRUGNAME", "DRUGINVOLV_ENG")))
_query("s6_export_reactions")(_exported("reactions", ("REPORT_ID", "PT_NAME_ENG", "SOC_NAME_ENG")))


@_query("s7_export_signals")
def _s7(spark, sf):
    path = new_shared_path(spark, "signals")
    t = disp.prr(disp.cells(_hlt_ct(spark, sf)))
    snapshots.export_signals(_r4(t.select("drug_code", "event_effect", "n11", "PRR")), path)
    return spark.read.schema("drug_code string, event_effect string, n11 long, PRR double").csv(path, header=True)


@_query("s8_read_nested")
def _s8(spark, sf):
    path = new_shared_path(spark, "nested")
    _docs(spark, sf).write.json(path)
    docs = nested_source.read_nested_reports(spark, path)
    return docs.select(
        "receivedate",
        "occurcountry",
        F.col("patient.patientsex").cast("long").alias("patientsex"),
        F.coalesce(F.size("patient.drug"), F.lit(0)).cast("long").alias("n_drug"),
        F.coalesce(F.size("patient.reaction"), F.lit(0)).cast("long").alias("n_reaction"),
    )


# --- cleaning ----------------------------------------------------------------


@_query("c1_clean_date")
def _c1(spark, sf):
    t = view(spark, sf, "extract_dates").select("REPORT_ID", "DATRECEIVED", "DATINTRECEIVED")
    return c.add_clean_dates(t)


@_query("c2_age_group")
def _c2(spark, sf):
    t = view(spark, sf, "reports")
    return t.select("REPORT_ID", c.age_group("AGE_Y").alias("AGE_GROUP_CLEAN"))


@_query("c3_require_complete")
def _c3(spark, sf):
    t = view(spark, sf, "reports").select("REPORT_ID", c.age_group("AGE_Y").alias("AGE_GROUP_CLEAN"))
    return c.require_complete(t, "AGE_GROUP_CLEAN")


@_query("c4_onset_age")
def _c4(spark, sf):
    t = view(spark, sf, "doc_reports")
    return t.select(
        "REPORT_ID", c.onset_age_years("patientonsetage", "patientonsetageunit").alias("age_years")
    )


@_query("c5_quarter")
def _c5(spark, sf):
    key = c.quarter_key("DATINTRECEIVED_CLEAN")
    return view(spark, sf, "reports").select(
        "REPORT_ID",
        key.alias("quarter"),
        c.quarter_label(key).alias("quarter_label"),
        c.quarter_start(key).alias("quarter_start"),
        c.quarter_from_label(c.quarter_label(key)).alias("quarter_back"),
    )


@_query("c6_relabel")
def _c6(spark, sf):
    t = view(spark, sf, "reports").select("REPORT_ID", "REPORTER_TYPE_ENG", "GENDER_ENG")
    return c.relabel(c.relabel(t, "REPORTER_TYPE_ENG", summaries.REPORTER_LABELS), "GENDER_ENG", summaries.SEX_LABELS)


@_query("c7_pad_id")
def _c7(spark, sf):
    return view(spark, sf, "reports").select("REPORT_ID", c.pad_id("REPORT_NO").alias("padded"))


@_query("c8_norm_term")
def _c8(spark, sf):
    return view(spark, sf, "reactions").select(c.norm_term("PT_NAME_ENG").alias("term")).distinct()


@_query("c9_drop_terms")
def _c9(spark, sf):
    # Names with every seventh blank turned into a reserved comma.
    t = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 7 == 0, F.replace("p_name", F.lit(" "), F.lit(",")))
        .otherwise(F.col("p_name"))
        .alias("term")
    )
    return c.drop_terms(t, "term").distinct()


@_query("c10_explode_ingredients")
def _c10(spark, sf):
    t = table(spark, sf, "part").select(F.concat_ws("|", "p_brand", "p_type").alias("ing"))
    return c.explode_ingredients(t)


@_query("c11_round_numeric")
def _c11(spark, sf):
    t = disp.prr(disp.cells(_hlt_ct(spark, sf)))
    return c.round_numeric(t.drop("n1_", "n_1", "N", "n10", "n01", "n00"), 3)


@_query("c12_bucket_date")
def _c12(spark, sf):
    d = "DATINTRECEIVED_CLEAN"
    return view(spark, sf, "reports").select(
        "REPORT_ID", c.bucket_date(d, "month").alias("month"), c.bucket_date(d, "year").alias("year")
    )


@_query("c13_pair_label")
def _c13(spark, sf):
    t = _cohort(spark, sf).select("ing", "PT_NAME_ENG").distinct()
    return t.select(c.pair_label("ing", "PT_NAME_ENG").alias("label"))


@_query("c14_standardise")
def _c14(spark, sf):
    return _r4(plans.standardise(disp.cells(_hlt_ct(spark, sf))))


# --- cohort search -----------------------------------------------------------


def _reports_where(conditions):
    def run(spark, sf):
        return search.where(view(spark, sf, "reports"), *conditions()).select("REPORT_ID")

    return run


_query("f1_in_period")(_reports_where(lambda: [search.in_period(*PERIOD)]))
_query("f1_in_period_same_month")(_reports_where(lambda: [search.in_period(*SAME_MONTH)]))
_query("f1_in_period_whole_months")(_reports_where(lambda: [search.in_period(*PERIOD, whole_months=True)]))
_query("f2_serious_death")(_reports_where(lambda: [search.serious_is("Death")]))
_query("f2_serious_excl_death")(_reports_where(lambda: [search.serious_is(search.SERIOUS_NO_DEATH)]))
_query("f3_gender")(_reports_where(lambda: [search.gender_is("Female")]))
_query("f4_age_between")(_reports_where(lambda: [search.age_between(0, 100)]))
_query("f4_age_open_top")(_reports_where(lambda: [search.age_between(18, 100, open_top=True)]))


@_query("f5_brand")
def _f5(spark, sf):
    return search.where(view(spark, sf, "report_drug"), search.brand_in(BRANDS)).select("REPORT_DRUG_ID")


@_query("f6_ingredient")
def _f6(spark, sf):
    t = _tables(spark, sf)
    return search.ingredient_in(t.drugs, t.ingredients, INGREDIENTS).select("REPORT_DRUG_ID")


@_query("f7_substance")
def _f7(spark, sf):
    t = _tables(spark, sf)
    return search.substance_is(t.drugs, t.substances, "ECONOMY").select("REPORT_DRUG_ID")


@_query("f8_involvement")
def _f8(spark, sf):
    return search.where(view(spark, sf, "report_drug"), search.involvement_is("Suspect")).select("REPORT_DRUG_ID")


@_query("f9_reaction")
def _f9(spark, sf):
    return search.reaction_in(view(spark, sf, "reactions"), TERMS)


@_query("f10_soc")
def _f10(spark, sf):
    return search.where(view(spark, sf, "reactions"), search.soc_in(SOCS)).select("REPORT_ID", "PT_NAME_ENG")


SEARCH = search.Query(
    lo=PERIOD[0],
    hi=PERIOD[1],
    seriousness=search.SERIOUS_NO_DEATH,
    gender="Female",
    age=(13, 100),
    over_100=True,
    ingredients=INGREDIENTS,
    involvement="Suspect",
    reactions=TERMS,
    socs=SOCS,
)
WIDE_SEARCH = search.Query(lo=PERIOD[0], hi=PERIOD[1], brands=BRANDS)


@_query("f11_search_reports")
def _f11(spark, sf):
    return search.search_reports(_tables(spark, sf), SEARCH)


@_query("f11_search_by_brand")
def _f11b(spark, sf):
    return search.search_reports(_tables(spark, sf), WIDE_SEARCH)


@_query("f12_is_empty")
def _f12(spark, sf):
    none = search.search_reports(_tables(spark, sf), search.Query(age=(150, 160)))
    some = view(spark, sf, "reports").agg(F.count(F.lit(1)).alias("n_all"))
    return some.withColumn("found_nothing", F.lit(search.is_empty(none)))


@_query("f13_restrict")
def _f13(spark, sf):
    t = _tables(spark, sf)
    return search.restrict(t.drugs, search.search_reports(t, WIDE_SEARCH)).select("REPORT_DRUG_ID")


@_query("f13_restrict_nothing_found")
def _f13b(spark, sf):
    t = _tables(spark, sf)
    ids = search.search_reports(t, search.Query(age=(150, 160)))
    return search.restrict(t.reactions, ids).groupBy("PT_NAME_ENG").agg(F.count(F.lit(1)).alias("n"))


@_query("f11_search_set")
def _f11c(spark, sf):
    return report_sets.search_set(_tables(spark, sf), SEARCH).members()


@_query("f13_panels")
def _f13c(spark, sf):
    # One search, stored as a set, and the panels of a dashboard that read it.
    t = _tables(spark, sf)
    found = report_sets.search_set(t, WIDE_SEARCH).stored()
    reports, drugs, reactions = (found.of_rows(x) for x in (t.reports, t.drugs, t.reactions))
    panels = {
        "sex": summaries.by_sex(reports).withColumnRenamed("GENDER_ENG", "value"),
        "outcome": summaries.by_outcome(reports).withColumnRenamed("OUTCOME_ENG", "value"),
        "reporter": summaries.by_reporter(reports).withColumnRenamed("REPORTER_TYPE_ENG", "value"),
        "total": found.count().select(F.lit("all").alias("value"), F.col("n_reports").alias("n")),
        "drug": drugs.groupBy(F.col("DRUGNAME").alias("value")).agg(F.count(F.lit(1)).alias("n")),
        "involvement": drugs.groupBy(F.col("DRUGINVOLV_ENG").alias("value")).agg(F.count(F.lit(1)).alias("n")),
        "reaction": reactions.groupBy(F.col("PT_NAME_ENG").alias("value")).agg(F.count(F.lit(1)).alias("n")),
        "class": reactions.groupBy(F.col("SOC_NAME_ENG").alias("value")).agg(F.count(F.lit(1)).alias("n")),
    }
    return joins.stack_labelled(panels)


@_query("f15_missing")
def _f15(spark, sf):
    return counts.missing_count(_docs(spark, sf), "patient.patientonsetage")


@_query("f16_filter_signals")
def _f16(spark, sf):
    t = plans.standardise(disp.prr(disp.cells(_hlt_ct(spark, sf))))
    kept = search.filter_signals(t, DRUGS, (), min_count=20.7, min_exp=15, drop_inf=True)
    return _r4(kept.select("drug_code", "event_effect", "count", "expected_count", "PRR"))


@_query("f17_analysis_cohort")
def _f17(spark, sf):
    return _cohort(spark, sf).groupBy("quarter", "ing").agg(F.count(F.lit(1)).alias("n"))


@_query("f18_min_count")
def _f18(spark, sf):
    return ctg.min_count(_pt_ct(spark, sf), 25)


# --- joins -------------------------------------------------------------------


@_query("j1_add_hierarchy")
def _j1(spark, sf):
    out = joins.add_hierarchy(view(spark, sf, "fact"), view(spark, sf, "hierarchy"))
    return out.groupBy("PT_NAME_ENG", "MEDDRA_VERSION", "HLT_NAME_ENG", "HLGT_NAME_ENG").agg(
        F.count(F.lit(1)).alias("n")
    )


@_query("j2_build_fact")
def _j2(spark, sf):
    t = _tables(spark, sf)
    return joins.build_fact(t.ingredients, t.drugs, t.reactions)


@_query("j3_in_reports")
def _j3(spark, sf):
    # Reports are chosen before rows meet: products without a report and reports outside fall out either way.
    tasks = report_tasks(spark, sf)
    drugs, reactions = rows_by_report(spark, sf, "report_drug", "reactions", tasks=tasks)
    chosen = joins.in_reports(drugs.select("REPORT_ID", "DRUG_PRODUCT_ID"), view(spark, sf, "reports"), *PERIOD)
    named = chosen.join(view(spark, sf, "drug_ingredients"), "DRUG_PRODUCT_ID")
    return counts.fact_pair_counts(named, reactions, "ACTIVE_INGREDIENT_NAME", "PT_NAME_ENG", tasks=tasks)


@_query("j4_attach_flags")
def _j4(spark, sf):
    t = _tables(spark, sf)
    flagged = search.attach_flags(t.reactions, t.reports)
    kept = search.where(flagged, search.serious_is(search.SERIOUS_NO_DEATH))
    return kept.select("REPORT_ID", "PT_NAME_ENG", "SERIOUSNESS_ENG", F.col("DEATH").cast("long").alias("DEATH"))


@_query("j5_semi_keys")
def _j5(spark, sf):
    # Key list: the ten most frequent pairs; both columns are the key.
    counted = _pt_counts(spark, sf)
    pairs = summaries.top_k(counted.withColumn("k", F.concat_ws("_", "DRUGNAME", "PT_NAME_ENG")), "k", 10, "count")
    rows = view(spark, sf, "report_drug").select("REPORT_ID", "REPORT_DRUG_ID", "DRUGNAME").join(
        view(spark, sf, "reactions").select("REPORT_ID", "PT_NAME_ENG"), "REPORT_ID"
    )
    return joins.semi_keys(rows, pairs, ["DRUGNAME", "PT_NAME_ENG"])


@_query("j6_with_all_categories")
def _j6(spark, sf):
    # "Past" does not occur in the table.
    per_kind = summaries.count_by(view(spark, sf, "report_drug"), "DRUGINVOLV_ENG", "DRUGINVOLV_ENG")
    return _long(
        joins.with_all_categories(per_kind, "DRUGINVOLV_ENG", ["Suspect", "Concomitant", "Treatment", "Past"]),
        "position",
    )


@_query("j7_class_counts")
def _j7(spark, sf):
    # Classes from different tables, by day: most days lack some of them.
    reports, drugs = view(spark, sf, "reports"), view(spark, sf, "report_drug")
    day = F.col("DATINTRECEIVED_CLEAN").alias("time_p")
    count = F.count(F.lit(1)).alias("n")
    chosen = drugs.filter(F.col("DRUGNAME").isin(*BRANDS)).select("REPORT_ID").distinct()
    return joins.merge_series(
        {
            "with_brand": reports.join(chosen, "REPORT_ID", "left_semi").groupBy(day).agg(count),
            "disabling": reports.filter("DISABILITY = 1").groupBy(day).agg(count),
            "fatal": reports.filter("DEATH = 1").groupBy(day).agg(count),
        }
    )


@_query("j8_fill_calendar")
def _j8(spark, sf):
    t = view(spark, sf, "events_months")
    return summaries.fill_calendar(t, "time_p", "month")


@_query("j9_densify")
def _j9(spark, sf):
    # Pairs, quarters and rows come from one stored table of counts.
    (fact,) = rows_by_report(spark, sf, "fact")
    rows = cut_lineage(counts.pair_rows_by_quarter(counts.analysis_cohort(fact, SINCE)))
    pairs = rows.select("ing", "PT_NAME_ENG")
    return joins.densify(pairs, counts.quarters(rows), rows, ["ing", "PT_NAME_ENG"])


@_query("j10_decode")
def _j10(spark, sf):
    t = view(spark, sf, "doc_reactions")
    return t.select("REPORT_ID", joins.decode("reactionoutcome", joins.OUTCOME_CODES).alias("label")).distinct()


@_query("j11_master_table")
def _j11(spark, sf):
    base = disp.cells(_hlt_ct(spark, sf))
    keys = ["drug_code", "event_effect"]
    merged = joins.master_table(
        disp.prr(base).select(*keys, "n11", "PRR"),
        disp.ror(base).select(*keys, "n11", "ROR"),
        disp.rrr(base).select(*keys, "RRR"),
    )
    return _r4(merged)


@_query("j12_union_versions")
def _j12(spark, sf):
    h = view(spark, sf, "hierarchy")
    parts = [h.filter(F.col("MEDDRA_VERSION") == v) for v in ("v.18.1", "v.19.0")]
    return _long(joins.union_versions(parts), "HLT_Code", "HLGT_Code", "SOC_Code", "Primary_PT_SOC")


@_query("j13_stack_labelled")
def _j13(spark, sf):
    reports = view(spark, sf, "reports")
    parts = {
        "sex": summaries.by_sex(reports).withColumnRenamed("GENDER_ENG", "value"),
        "outcome": summaries.by_outcome(reports).withColumnRenamed("OUTCOME_ENG", "value"),
    }
    return joins.stack_labelled(parts)


@_query("j14_coverage")
def _j14(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_brand").alias("ing"))
    catalogues = {
        "small": table(spark, sf, "part").filter("p_size < 2").select(F.lower("p_brand").alias("a")),
        "economy": table(spark, sf, "part").filter("p_type = 'ECONOMY' AND p_size > 48").select("p_brand"),
    }
    return joins.coverage(names, catalogues)


# --- counts and summaries ----------------------------------------------------


@_query("a1_pair_counts_pt")
def _a1(spark, sf):
    return _cohort_counts(spark, sf)


@_query("a1_pair_counts_stored")
def _a1c(spark, sf):
    fact = view(spark, sf, "fact").select("REPORT_ID", "ing", "PT_NAME_ENG", "quarter")
    stored = stored_fact.write_stored(fact, new_shared_path(spark, "fact"), _buckets(spark))
    return stored_fact.distinct_reports(counts.analysis_cohort(stored, SINCE), ["ing", "PT_NAME_ENG"])


@_query("a1_pair_counts_from_tables")
def _a1b(spark, sf):
    return _pt_counts(spark, sf)


@_query("a2_pair_counts_hlt")
def _a2(spark, sf):
    return _cohort_counts(spark, sf, "HLT")


@_query("a3_pair_counts_quarter")
def _a3(spark, sf):
    return _cohort_counts(spark, sf, by="quarter")


@_query("a4_pair_rows_quarter")
def _a4(spark, sf):
    return counts.pair_rows_by_quarter(counts.analysis_cohort(view(spark, sf, "fact"), SINCE, require_pt=False), "HLT")


@_query("a5_quarters")
def _a5(spark, sf):
    return counts.quarters(_cohort(spark, sf))


@_query("a6_contingency")
def _a6(spark, sf):
    return _pt_ct(spark, sf)


@_query("a6_contingency_threshold")
def _a6b(spark, sf):
    # A threshold that removes some drugs and events: the fix-point takes rounds.
    pairs = _pt_counts(spark, sf)
    return ctg.contingency(pairs, "DRUGNAME", "PT_NAME_ENG", min_margin=MARGIN)


@_query("a7_report_series")
def _a7(spark, sf):
    return summaries.report_series(view(spark, sf, "reports"))


@_query("a7_report_series_monthly")
def _a7b(spark, sf):
    t = view(spark, sf, "reports").filter(F.col("DATINTRECEIVED_CLEAN").between("1997-02-10", "1998-11-20"))
    return summaries.report_series(t)


@_query("a8_report_total")
def _a8(spark, sf):
    return counts.report_total(view(spark, sf, "report_drug"))


def _on_reports(fn):
    return lambda spark, sf: fn(view(spark, sf, "reports"))


def _positioned(fn):
    return lambda spark, sf: _long(fn(view(spark, sf, "reports")), "position")


_query("a9_by_reporter")(_on_reports(summaries.by_reporter))
_query("a10_by_seriousness")(_positioned(summaries.by_seriousness))
_query("a11_serious_reasons")(_positioned(summaries.serious_reasons))
_query("a12_by_sex")(_on_reports(summaries.by_sex))
_query("a13_by_age_group")(_positioned(summaries.by_age_group))
_query("a14_age_histogram")(_on_reports(summaries.age_histogram))
_query("a15_age_excluded")(_on_reports(summaries.age_excluded))
_query("a22_by_outcome")(_on_reports(summaries.by_outcome))


def _on(name, fn):
    return lambda spark, sf: fn(view(spark, sf, name))


_query("a16_top_indications")(_on("report_drug", summaries.top_indications))
_query("a17_top_drugs")(_on("report_drug", summaries.top_drugs))
_query("a17_top_drugs_suspect")(_on("report_drug", lambda t: summaries.top_drugs(t, "Suspect")))
_query("a17_top_drugs_concomitant")(_on("report_drug", lambda t: summaries.top_drugs(t, "Concomitant")))
_query("a17_top_drugs_none")(_on("report_drug", lambda t: summaries.top_drugs(t, "Interacting")))
_query("a18_drugs_per_report")(_on("report_drug", summaries.drugs_per_report))
_query("a19_reports_over")(_on("report_drug", lambda t: summaries.reports_over(t, 6)))
_query("a20_top_pt")(_on("reactions", lambda t: summaries.top_terms(t, "PT")))
_query("a21_top_hlt")(_on("reactions", lambda t: summaries.top_terms(t, "HLT")))
_query("a23_vocabulary_brand")(_on("report_drug", lambda t: vocab.vocabulary(t, "DRUGNAME", clean=True)))
_query("a23_vocabulary_reaction")(_on("reactions", lambda t: vocab.vocabulary(t, "PT_NAME_ENG", "SMQ")))
_query("a23_vocabulary_ingredient")(_on("drug_ingredients", lambda t: vocab.vocabulary(t, "ACTIVE_INGREDIENT_NAME")))
_query("a23_vocabulary_substance")(_on("substances", lambda t: vocab.vocabulary(t, "ing")))
_query("a23_vocabulary_soc")(_on("reactions", lambda t: vocab.vocabulary(t, "SOC_NAME_ENG")))
_query("a24_term_map")(lambda spark, sf: vocab.term_map(_cohort(spark, sf)))
_query("a25_choices_hlt")(
    lambda spark, sf: vocab.choices(vocab.term_map(_cohort(spark, sf)), "HLT_NAME_ENG", drugs=DRUGS[:1])
)
_query("a25_choices_pt")(
    lambda spark, sf: vocab.choices(vocab.term_map(_cohort(spark, sf)), "PT_NAME_ENG", drugs=DRUGS, hlts=HLTS)
)


def _pair_series(spark: SparkSession, sf: str, level: str, min_count: int) -> DataFrame:
    # One stored table of counts per quarter gives the signal table, the rows and the quarters.
    stored = cut_lineage(_cohort_rows(spark, sf, level))
    event = counts.level_column(level)
    pairs = stored.groupBy("ing", event).agg(F.sum("count").alias("count"))
    chosen = plans.signals_from_counts(pairs, "ing", event, exact=False, ordered=False).filter(F.col("count") >= min_count)
    return series.pair_series(chosen, stored.drop("count"), level)


_query("a26_pair_series")(lambda spark, sf: _pair_series(spark, sf, "PT", 1))
_query("a26_pair_series_hlt")(lambda spark, sf: _pair_series(spark, sf, "HLT", 3))


@_query("a27_total_series")
def _a27(spark, sf):
    return series.total_series(_cohort_rows(spark, sf), DRUGS)


# --- nested documents --------------------------------------------------------


#: Where an application has written the nested documents of a data folder.
_NESTED: dict[tuple[str, str], str] = {}


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, built from the flat tables once in an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _NESTED:
        path = new_shared_path(spark, "documents")
        rows = rows_by_report(spark, sf, "doc_drugs", "doc_reactions")
        nested_source.nest_reports(view(spark, sf, "doc_reports"), *rows).write.parquet(path)
        _NESTED[key] = path
    return spark.read.parquet(_NESTED[key])


def _on_docs(fn):
    return lambda spark, sf: fn(_docs(spark, sf))


def _found(spark, sf):
    return nested.search_nested(_docs(spark, sf), *PERIOD, generics=DRUGS, reactions=TERMS[:2])


_query("f14_search_nested")(lambda spark, sf: nested.nested_total(_found(spark, sf)))
_query("f14_search_nested_brand")(
    lambda spark, sf: nested.nested_counts(
        nested.search_nested(_docs(spark, sf), *PERIOD, brands=BRANDS), nested.REACTION
    )
)
_query("a8_nested_total")(_on_docs(nested.nested_total))
_query("a23_nested_vocabulary")(_on_docs(lambda d: nested.nested_vocabulary(d, nested.GENERIC)))
_query("a28_nested_series")(_on_docs(nested.nested_series))
_query("a29_nested_reporter")(
    _on_docs(lambda d: nested.nested_by(d, "primarysource.qualification", joins.REPORTER_CODES))
)
_query("a29_nested_seriousness")(_on_docs(lambda d: _long(nested.nested_seriousness(d), "position")))
_query("a29_nested_sex")(_on_docs(lambda d: nested.nested_by(d, "patient.patientsex", joins.SEX_CODES)))
_query("a29_nested_outcome")(_on_docs(lambda d: nested.nested_by(d, nested.OUTCOME, joins.OUTCOME_CODES)))
_query("a30_nested_reasons")(_on_docs(lambda d: _long(nested.nested_reasons(d), "position")))
_query("a31_nested_countries")(_on_docs(nested.nested_countries))
_query("a32_nested_top_indication")(_on_docs(lambda d: nested.nested_top(d, nested.INDICATION)))
_query("a32_nested_top_generic")(_on_docs(lambda d: nested.nested_top(d, nested.GENERIC)))
_query("a32_nested_top_class")(_on_docs(lambda d: nested.nested_top(d, nested.DRUG_CLASS)))
_query("a32_nested_top_pt")(_on_docs(lambda d: nested.nested_top(d, nested.REACTION)))
_query("a33_nested_top_hlt")(
    lambda spark, sf: nested.nested_top_hlt(_docs(spark, sf), view(spark, sf, "hierarchy"), 15)
)
_query("a34_nested_ages")(_on_docs(nested.nested_ages))
_query("a34_nested_age_groups")(_on_docs(lambda d: _long(nested.nested_age_groups(d), "position")))
_query("a34_nested_age_histogram")(_on_docs(nested.nested_age_histogram))
_query("a34_nested_age_excluded")(_on_docs(nested.nested_age_excluded))


# --- statistics --------------------------------------------------------------


def _stat(fn, ct=_pt_ct):
    return lambda spark, sf: _r4(fn(disp.cells(ct(spark, sf))))


_query("d0_cells")(_stat(lambda t: t))
_query("d1_prr")(_stat(disp.prr))
_query("d2_ror")(_stat(disp.ror))
_query("d3_rrr")(_stat(disp.rrr))
_KEYS = ("drug_code", "event_effect", "n11")
_query("d4_d5_rfet_pt")(_stat(lambda t: disp.rfet(t).select(*_KEYS, "RFET", "midRFET")))
_query("d4_d5_rfet_hlt")(_stat(lambda t: disp.rfet(t).select(*_KEYS, "RFET", "midRFET"), _hlt_ct))
_query("d4_rfet_or2")(_stat(lambda t: disp.rfet(t, or0=2, min_n11=100).select(*_KEYS, "RFET", "midRFET"), _hlt_ct))
_BCPNN = (*_KEYS, "IC", "var_IC", "LB95_IC", "UB95_IC", "postH0")
_query("d6_bcpnn_pt")(_stat(lambda t: bayes.bcpnn(t).select(*_BCPNN)))
_query("d6_bcpnn_hlt")(_stat(lambda t: bayes.bcpnn(t, rr0=1.1, min_n11=90).select(*_BCPNN), _hlt_ct))
_query("d7_bcpnn_mc")(_stat(lambda t: bayes.bcpnn_mc(t, draws=1000, seed=7), _hlt_ct))


def _closed_and_sampled(sampled: DataFrame, closed: DataFrame, draws: int) -> DataFrame:
    """Whether sampled components agree with the closed form within the error of the draws.

    The median may differ from the mean by a fifth of a standard deviation, and the bounds
    from those of a normal density by the term of its skewness, about the root of 1 / n11.
    """
    keys = ["drug_code", "event_effect"]
    t = sampled.join(closed.select(*keys, F.col("IC").alias("_mean"), F.sqrt("var_IC").alias("_sd"), F.sqrt("n11").alias("_root")), keys)
    error = 0.2 + 8 / draws**0.5
    skew = lambda z: 0.5 * (z * z - 1) / F.col("_root") if z else F.lit(0.0)
    near = lambda c, z: F.abs((F.col(c) - F.col("_mean")) / F.col("_sd") - z) < skew(z) + error
    return t.withColumns(
        {"mean": F.col("_mean"), "median_near": near("median_IC", 0), "lower_near": near("LB95_IC", -1.96), "upper_near": near("UB95_IC", 1.96)}
    )


_NEAR = ("mean", "median_near", "lower_near", "upper_near")


@_query("d7_sampled_and_closed")
def _d7b(spark, sf):
    ct = disp.cells(_pt_ct(spark, sf))
    draws = 1000
    both = _closed_and_sampled(bayes.bcpnn_mc(ct, draws=draws, seed=3), bayes.bcpnn(ct, log_base=math.e), draws)
    return _r4(both.select(*_KEYS, *_NEAR))


@_query("d8a_gps_likelihood")
def _d8a_likelihood(spark, sf):
    return c.round_numeric(shrinkage.gps_likelihood(_pt_ct(spark, sf), PRIOR), 8)


@_query("d8a_gps_fit")
def _d8a(spark, sf):
    ct = _pt_ct(spark, sf)
    prior = shrinkage.gps_fit(ct)
    # One row per number of reports: cells and their mean expected count, with the fitted prior.
    t = disp.cells(ct).groupBy("n11").agg(F.count(F.lit(1)).alias("cells"), F.avg("expected_count").alias("mean_e"))
    return t.withColumns(
        {name: F.lit(float(getattr(prior, name))) for name in ("alpha1", "beta1", "alpha2", "beta2", "w", "log_likelihood")}
    )


_GPS_MEANS = (*_KEYS, "n11_over_E", "Q", "postE_lambda", "postE_log2_lambda")
_query("d8b_gps_means")(_stat(lambda t: shrinkage.gps(t, PRIOR, quantiles=False).select(*_GPS_MEANS)))
_query("d8b_gps_null_probability")(_stat(lambda t: shrinkage.gps(t, PRIOR).select(*_KEYS, "postH0")))
_query("d8b_gps_quantile")(_stat(lambda t: shrinkage.gps(t, PRIOR).select(*_KEYS, "Q05_lambda"), _hlt_ct))


def _signals(level):
    def run(spark, sf):
        return _r4(plans.signals_from_counts(_cohort_counts(spark, sf, level), "ing", counts.level_column(level)))

    return run


_query("d9_signals_pt")(_signals("PT"))
_query("d9_signals_hlt")(_signals("HLT"))


@_query("d9_signals_gps")
def _d9_gps(spark, sf):
    pairs = _cohort_counts(spark, sf, "HLT")
    t = plans.signals_from_counts(pairs, "ing", "HLT_NAME_ENG", exact=False, ordered=False, prior=PRIOR)
    return _r4(t.select("drug_code", "event_effect", "count", "median_IC", "postE_lambda", "postE_log2_lambda", "gps_postH0"))


def _quarter_signals(spark: SparkSession, sf: str, **options) -> DataFrame:
    pairs = _cohort_counts(spark, sf, "HLT", by="quarter")
    return plans.signals_from_counts(pairs, "ing", "HLT_NAME_ENG", by="quarter", ordered=False, **options)


@_query("d9_signals_sampled")
def _d9_sampled(spark, sf):
    pairs = _cohort_counts(spark, sf, "HLT")
    draws = 2000
    t = plans.signals_from_counts(pairs, "ing", "HLT_NAME_ENG", draws=draws, ordered=False)
    closed = bayes.bcpnn(ctg.contingency(pairs, "ing", "HLT_NAME_ENG"), log_base=math.e)
    both = _closed_and_sampled(t, closed, draws)
    return _r4(both.select("drug_code", "event_effect", "count", "drug_margin", "event_margin", "N", "PRR", "ROR", "RRR", "RFET", *_NEAR))


@_query("d10_signals_quarter")
def _d10(spark, sf):
    ratios = [f"{bound}{name}" for name in ("PRR", "ROR", "RRR") for bound in ("", "LB95_", "UB95_")]
    t = _quarter_signals(spark, sf)
    return _r4(t.select("quarter", "drug_code", "event_effect", "count", "drug_margin", "event_margin", "N",
                        "expected_count", *ratios, "RFET", "midRFET", "median_IC", "LB95_IC"))


@_query("d11_cumulative_contingency")
def _d11(spark, sf):
    rows = _cohort_counts(spark, sf, by="quarter")
    return plans.cumulative_contingency(rows, "ing", "PT_NAME_ENG")


@_query("d12_cumulative_ic")
def _d12(spark, sf):
    out = plans.cumulative_ic(_quarter_signals(spark, sf, exact=False))
    return _r4(out.select("quarter", "drug_code", "event_effect", "IC_cumulative", "LB95_IC_cumulative"))


def _quarter_store(spark: SparkSession, sf: str, level: str, score: bool = False) -> quarter_store.QuarterStore:
    """The cohort's history in one load, then its last two quarters one by one, as they would come in."""
    tasks = report_tasks(spark, sf)
    drugs, terms = _cohort_sides(spark, sf, tasks)
    event = counts.level_column(level)
    store = quarter_store.QuarterStore(spark, new_shared_path(spark, "quarters"))
    # What comes in: the counts of every quarter, made in one pass over the reports.
    incoming = cut_lineage(counts.pair_counts_from_tables(drugs, terms, "ing", event, by="quarter", tasks=tasks))
    late = [r.quarter for r in drugs.select("quarter").distinct().orderBy(F.col("quarter").desc()).limit(2).collect()]
    steps = [~F.col("quarter").isin(late), *[F.col("quarter") == q for q in reversed(late)]]
    for k, step in enumerate(steps):
        store.load(incoming.filter(step), "ing", event)
        if k == 0:
            store.compact()
        if score:
            store.score(exact=False)
    return store


@_query("a3_quarters_loaded")
def _a3_loaded(spark, sf):
    store = _quarter_store(spark, sf, "PT")
    names = {"drug_code": "ing", "event_effect": "PT_NAME_ENG", "n11": "count"}
    return store.pairs().withColumnsRenamed(names)


@_query("d11_quarters_loaded")
def _d11_loaded(spark, sf):
    return _quarter_store(spark, sf, "PT").cumulative_contingency()


@_query("d12_quarters_loaded")
def _d12_loaded(spark, sf):
    out = _quarter_store(spark, sf, "HLT", score=True).scores()
    return _r4(out.select("quarter", "drug_code", "event_effect", "count", "drug_margin", "event_margin", "N", "PRR", "median_IC",
                          "IC_cumulative", "LB95_IC_cumulative"))


_RATES = ("drug_code", "event_effect", "rank", "FDR", "FNR", "Se", "Sp")


@_query("d13_error_rates_null_probability")
def _d13(spark, sf):
    stats = _ranked_stats(_pt_ct(spark, sf))
    return _r4(ranking.error_rates(stats).select(*_RATES))


@_query("d13_error_rates_lower_bound")
def _d13b(spark, sf):
    stats = _ranked_stats(_hlt_ct(spark, sf))
    return _r4(ranking.error_rates(stats, "LB95_IC").select(*_RATES))


@_query("d13_error_rates_gps")
def _d13c(spark, sf):
    stats = shrinkage.gps(_hlt_ct(spark, sf), PRIOR).select(*_KEYS, F.round("postH0", 6).alias("postH0"))
    return _r4(ranking.error_rates(stats).select(*_RATES))


def _ranked_stats(ct: DataFrame) -> DataFrame:
    # Rounded, so that the order is the same in both engines.
    stats = bayes.bcpnn(ct)
    return stats.select("drug_code", "event_effect", F.round("postH0", 6).alias("postH0"), F.round("LB95_IC", 6).alias("LB95_IC"))
