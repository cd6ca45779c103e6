"""Descriptive summaries of a report cohort.

Each is one aggregate over the cohort: breakdowns that look like several
questions (seriousness, its reasons, three series) are conditional counts in a
single pass. Ties of top-k lists are broken by the label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.functions.cleaning import AGE_GROUPS, age_group, recode
from sentria.operators.joins import with_all_categories

# Labels of blank or long categories.
REPORTER_LABELS = {
    "": "Not reported",
    "Consumer Or Other Non Health Professional": "Consumer or non-health professional",
    "Other Health Professional": "Other health professional",
}
SEX_LABELS = {"": "Not specified"}

# Reasons for seriousness and the flag of each.
SERIOUS_REASONS = {
    "Death": "DEATH",
    "Life-threatening": "LIFE_THREATENING",
    "Hospitalization": "HOSP_REQUIRED",
    "Disability": "DISABILITY",
    "Congenital anomaly": "CONGENITAL_ANOMALY",
    "Other medically important condition": "OTHER_MEDICALLY_IMP_COND",
}

TWO_YEARS = 730  # days from which a series has year buckets


def _is(column: str, value) -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False))


def count_by(t: DataFrame, key: Column | str, name: str, value: str = "n") -> DataFrame:
    """Rows per value of a column or expression."""
    c = F.col(key) if isinstance(key, str) else key
    return t.groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias(value))


def unpivot_counts(one_row: DataFrame, labels: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A row of counts as ``(position, label, n)`` rows."""
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(c).cast("long").alias("n"))
        for i, (label, c) in enumerate(zip(labels, columns))
    ]
    return one_row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def top_k(counts: DataFrame, label: str, k: int, value: str = "n") -> DataFrame:
    """The k largest counts."""
    return counts.orderBy(F.col(value).desc(), F.col(label).asc()).limit(k)


def or_none_row(top: DataFrame, label: str, value: str = "n") -> DataFrame:
    """A single ``None`` row with 0 when a list is empty."""
    empty = (
        top.agg(F.count(F.lit(1)).alias("_k"))
        .filter(F.col("_k") == 0)
        .select(F.lit("None").alias(label), F.lit(0).cast("long").alias(value))
    )
    return top.unionByName(empty)


def report_series(reports: DataFrame) -> DataFrame:
    """Gap-free time series of serious (without death), fatal and non-serious reports.

    Year buckets when the cohort spans at least 730 days, else months; the
    choice is made inside the plan. Both ends are floored, so the last partial
    bucket is kept.
    """
    dated = reports.select("DATINTRECEIVED_CLEAN", "SERIOUSNESS_ENG", "DEATH")
    d = F.col("DATINTRECEIVED_CLEAN")
    bounds = reports.agg(F.min(d).alias("lo"), F.max(d).alias("hi"))
    by_year = F.datediff("hi", "lo") >= TWO_YEARS
    yearly = bounds.select(by_year).scalar()
    bucket = F.when(yearly, F.trunc(d, "year")).otherwise(F.trunc(d, "month"))
    serious = _is("SERIOUSNESS_ENG", "Yes") & (F.col("DEATH").isNull() | _is("DEATH", 2))
    series = (
        dated.groupBy(bucket.alias("time_p"))
        .agg(
            F.count_if(serious).alias("serious_excl_death"),
            F.count_if(_is("DEATH", 1)).alias("death"),
            F.count_if(_is("SERIOUSNESS_ENG", "No")).alias("nonserious"),
        )
        .filter(F.col("time_p").isNotNull())
    )
    years = F.sequence(F.trunc("lo", "year"), F.trunc("hi", "year"), F.expr("interval 1 year"))
    months = F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))
    calendar = bounds.select(F.explode(F.when(by_year, years).otherwise(months)).alias("time_p"))
    return calendar.join(series, "time_p", "left").na.fill(0)


def fill_calendar(series: DataFrame, date: str = "time_p", unit: str = "month") -> DataFrame:
    """A row for every month or year between the first and the last of a bucketed series."""
    step = F.expr(f"interval 1 {unit}")
    calendar = series.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).select(
        F.explode(F.sequence("lo", "hi", step)).alias(date)
    )
    return calendar.join(series, date, "left").na.fill(0)


def by_reporter(reports: DataFrame) -> DataFrame:
    return count_by(reports, recode("REPORTER_TYPE_ENG", REPORTER_LABELS), "REPORTER_TYPE_ENG")


def by_sex(reports: DataFrame) -> DataFrame:
    return count_by(reports, recode("GENDER_ENG", SEX_LABELS), "GENDER_ENG")


def by_outcome(reports: DataFrame) -> DataFrame:
    return count_by(reports, "OUTCOME_ENG", "OUTCOME_ENG")


def by_seriousness(reports: DataFrame) -> DataFrame:
    """Serious reports minus deaths, deaths, non-serious and blank, in this order.

    The first is a difference of two totals, not a predicate. Categories without
    any report are left out.
    """
    row = reports.agg(
        F.count_if(_is("SERIOUSNESS_ENG", "Yes")).alias("yes"),
        F.count_if(_is("DEATH", 1)).alias("death"),
        F.count_if(_is("SERIOUSNESS_ENG", "No")).alias("no"),
        F.count_if(_is("SERIOUSNESS_ENG", "")).alias("blank"),
    ).withColumn("serious", F.when(F.col("yes") > 0, F.col("yes") - F.col("death")))
    for c in ("death", "no", "blank"):
        row = row.withColumn(c, F.when(F.col(c) > 0, F.col(c)))
    labels = ["Serious(Excluding Death)", "Death", "Non-serious", "Not reported"]
    return unpivot_counts(row, labels, ["serious", "death", "no", "blank"]).filter(F.col("n").isNotNull())


def serious_reasons(reports: DataFrame) -> DataFrame:
    """Serious reports per reason, and those without any; seven rows from one pass."""
    flags = {label: _is(column, 1) for label, column in SERIOUS_REASONS.items()}
    any_flag = F.lit(False)
    for flag in flags.values():
        any_flag = any_flag | flag
    conditions = [*flags.values(), ~any_flag]
    names = [f"c{i}" for i in range(len(conditions))]
    row = reports.filter(F.col("SERIOUSNESS_ENG") == "Yes").agg(
        *[F.count_if(c).alias(n) for c, n in zip(conditions, names)]
    )
    return unpivot_counts(row, [*flags, "Not specified"], names)


def _group_of(reports: DataFrame) -> Column:
    # Tables from an extract carry the group; others get it from the age.
    return F.col("AGE_GROUP_CLEAN") if "AGE_GROUP_CLEAN" in reports.columns else age_group("AGE_Y")


def by_age_group(reports: DataFrame) -> DataFrame:
    """Reports per age group; all seven groups are present."""
    counts = count_by(reports, _group_of(reports), "AGE_GROUP_CLEAN")
    return with_all_categories(counts, "AGE_GROUP_CLEAN", [*AGE_GROUPS, "Unknown"])


def age_bins(
    t: DataFrame, age: str, group: Column, width: float = 2, hi: float = 100, weight: Column | None = None
) -> DataFrame:
    """Histogram by age group: right-closed bins, the first including its lower end."""
    a = F.col(age)
    index = F.greatest(F.ceil(a / width), F.lit(1))
    return (
        t.filter(a.between(0, hi))
        .groupBy(group.alias("age_group"), index.cast("long").alias("bin"))
        .agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("n"))
        .withColumns({"bin_lo": (F.col("bin") - 1) * width, "bin_hi": F.col("bin") * width})
    )


def age_histogram(reports: DataFrame, width: float = 2, hi: float = 100) -> DataFrame:
    """Reports per age bin and group; unknown ages and ages above ``hi`` are left out."""
    return age_bins(reports, "AGE_Y", _group_of(reports), width, hi)


def age_excluded(reports: DataFrame, hi: float = 100) -> DataFrame:
    """Number of ages the histogram leaves out at the top."""
    return reports.agg(F.count_if(F.col("AGE_Y") > hi).alias("n"))


def top_indications(drugs: DataFrame, k: int = 25) -> DataFrame:
    name = "INDICATION_NAME_ENG"
    counts = count_by(drugs.filter(F.col(name).isNotNull()), name, name)
    return or_none_row(top_k(counts, name, k), name)


def top_drugs(drugs: DataFrame, involvement: str | None = None, k: int = 25) -> DataFrame:
    """Drugs by distinct reports, optionally of one kind of involvement."""
    rows = drugs.filter(F.col("DRUGINVOLV_ENG") == involvement) if involvement else drugs
    counts = count_by(rows.select("REPORT_ID", "DRUGNAME").distinct(), "DRUGNAME", "DRUGNAME")
    top = top_k(counts, "DRUGNAME", k)
    return or_none_row(top, "DRUGNAME") if involvement else top


def _rows_per_report(drugs: DataFrame) -> DataFrame:
    return drugs.groupBy("REPORT_ID").agg(F.count(F.lit(1)).alias("n_drugs"))


def drugs_per_report(drugs: DataFrame, most: int = 20) -> DataFrame:
    """Reports by their number of drug rows, up to ``most``."""
    return count_by(_rows_per_report(drugs).filter(F.col("n_drugs") <= most), "n_drugs", "n_drugs", "n_reports")


def reports_over(drugs: DataFrame, most: int = 20) -> DataFrame:
    """Number of reports with more drug rows than that."""
    return _rows_per_report(drugs).agg(F.count_if(F.col("n_drugs") > most).alias("n"))


def top_terms(reactions: DataFrame, level: str = "PT", k: int = 15) -> DataFrame:
    """Preferred or high-level terms by rows; null high-level terms are left out."""
    name = {"PT": "PT_NAME_ENG", "HLT": "HLT_Term"}[level.upper()]
    rows = reactions.filter(F.col(name).isNotNull()) if level.upper() == "HLT" else reactions
    return top_k(count_by(rows, name, name), name, k)
