"""Search and summaries over nested report documents.

A term count is the number of documents with the term: arrays are made distinct
inside the row and exploded, then counted with partial aggregation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentria.functions.cleaning import (
    AGE_GROUPS,
    ONSET_UNIT_LABELS,
    age_group,
    drop_terms,
    norm_term,
    onset_age_years,
)
from sentria.operators.joins import decode, with_all_categories
from sentria.operators.summaries import age_bins, fill_calendar, top_k, unpivot_counts

GENERIC = "patient.drug.openfda.generic_name"
BRAND = "patient.drug.openfda.brand_name"
DRUG_CLASS = "patient.drug.openfda.pharm_class_epc"
INDICATION = "patient.drug.drugindication"
REACTION = "patient.reaction.reactionmeddrapt"
OUTCOME = "patient.reaction.reactionoutcome"

# Labels of the reasons for seriousness and their flags.
NESTED_REASONS = {
    "Death": "death",
    "Life-threatening condition": "lifethreatening",
    "Hospitalization": "hospitalization",
    "Disabling": "disabling",
    "Congenital anomaly": "congenitalanomali",
    "Other serious condition": "other",
}


def _is_one(path: str) -> Column:
    return F.coalesce(F.col(path) == 1, F.lit(False))


def _values(docs: DataFrame, path: str) -> tuple[Column, bool]:
    """The distinct non-null values under a path as one array, or a scalar column."""
    kind = docs.select(path).schema[0].dataType
    c = F.col(path)
    if not isinstance(kind, T.ArrayType):
        return c, False
    if isinstance(kind.elementType, T.ArrayType):
        c = F.flatten(F.filter(c, lambda a: a.isNotNull()))
    return F.array_distinct(F.filter(c, lambda v: v.isNotNull())), True


def any_of(docs: DataFrame, path: str, terms: Sequence[str]) -> Column | None:
    """Documents with any of the terms under an array path."""
    if not terms:
        return None
    values, _ = _values(docs, path)
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(t) for t in terms])), F.lit(False))


def search_nested(
    docs: DataFrame,
    lo: dt.date | None = None,
    hi: dt.date | None = None,
    generics: Sequence[str] = (),
    brands: Sequence[str] = (),
    reactions: Sequence[str] = (),
) -> DataFrame:
    """Documents received between two dates (both included) with any listed drug and any listed reaction."""
    out = docs
    if lo is not None and hi is not None:
        out = out.filter(F.col("receivedate").between(F.lit(lo), F.lit(hi)))
    for path, terms in ((GENERIC, generics), (BRAND, brands), (REACTION, reactions)):
        condition = any_of(docs, path, terms)
        if condition is not None:
            out = out.filter(condition)
    return out


def nested_total(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_reports"))


def nested_counts(docs: DataFrame, path: str) -> DataFrame:
    """Documents per value under a path: ``term, n``; missing values are left out."""
    values, is_array = _values(docs, path)
    terms = docs.select((F.explode(values) if is_array else values).alias("term"))
    return terms.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def nested_series(docs: DataFrame) -> DataFrame:
    """Gap-free monthly totals, serious and fatal reports."""
    month = F.trunc("receivedate", "month").alias("month")
    series = (
        docs.filter(F.col("receivedate").isNotNull())
        .groupBy(month)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(_is_one("serious")).alias("serious"),
            F.count_if(_is_one("seriousness.death")).alias("death"),
        )
    )
    return fill_calendar(series, "month", "month")


def nested_by(
    docs: DataFrame,
    path: str,
    codes: Mapping[int, str],
    missing: str | None = "Not reported",
) -> DataFrame:
    """Documents per code label, plus those without the field if there are any: ``label, n``.

    Codes outside the list keep a null label. ``missing=None`` leaves the last row out.
    """
    if missing is None or isinstance(docs.select(path).schema[0].dataType, T.ArrayType):
        return nested_counts(docs, path).select(decode("term", codes).alias("label"), "n")
    # A scalar field: one grouped count serves the values and the missing row.
    counted = docs.groupBy(F.col(path).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("term").isNull(), F.lit(missing)).otherwise(decode("term", codes))
    return counted.select(label.alias("label"), "n")


def nested_seriousness(docs: DataFrame) -> DataFrame:
    """Serious, non-serious and not reported documents, in this order."""
    row = docs.agg(
        F.count_if(_is_one("serious")).alias("serious"),
        F.count_if(F.col("serious").isNotNull() & ~_is_one("serious")).alias("other"),
        F.count_if(F.col("serious").isNull()).alias("missing"),
    )
    labels = ["Serious", "Non-serious", "Not Reported"]
    return unpivot_counts(row, labels, ["serious", "other", "missing"]).filter(F.col("n") > 0)


def nested_reasons(docs: DataFrame) -> DataFrame:
    """Documents per reason for seriousness; six rows from one pass."""
    names = list(NESTED_REASONS.values())
    row = docs.agg(*[F.count_if(_is_one(f"seriousness.{n}")).alias(n) for n in names])
    return unpivot_counts(row, list(NESTED_REASONS), names)


def nested_countries(docs: DataFrame, k: int = 10, missing: str = "not reported") -> DataFrame:
    """The k countries with most documents, then those without a country."""
    counted = docs.groupBy(F.col("occurcountry").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    top = top_k(counted.filter(F.col("term").isNotNull()), "term", k)
    absent = counted.filter(F.col("term").isNull()).select(F.lit(missing).alias("term"), "n")
    return top.unionByName(absent)


def nested_top(docs: DataFrame, path: str, k: int = 25) -> DataFrame:
    """The k terms under an array path with most documents."""
    return top_k(nested_counts(docs, path), "term", k)


def nested_top_hlt(docs: DataFrame, hierarchy: DataFrame, k: int = 25) -> DataFrame:
    """High-level terms by summed preferred-term counts: the k largest with all ties.

    Terms match in upper case over all dictionary versions; a preferred term
    counts once per high-level term.
    """
    links = (
        hierarchy.filter(F.col("Primary_SOC_flag") == "Y")
        .select(norm_term("PT_Term").alias("_key"), "HLT_Term")
        .distinct()
    )
    counts = nested_counts(docs, REACTION).withColumn("_key", norm_term("term"))
    rolled = (
        counts.join(links, "_key")
        .select("term", "HLT_Term", "n")
        .distinct()
        .groupBy("HLT_Term")
        .agg(F.sum("n").alias("n"))
    )
    # The k-th largest count as a scalar keeps all ties without a global window.
    cut = rolled.select("n").orderBy(F.col("n").desc()).limit(k).agg(F.min("n")).scalar()
    return rolled.filter(F.col("n") >= cut)


def nested_ages(docs: DataFrame) -> DataFrame:
    """Documents per onset age in years: ``age, n, age_group``.

    Documents without an age form one row with a null age; an age with a missing
    or unknown unit is in no row.
    """
    age, unit = F.col("patient.patientonsetage"), F.col("patient.patientonsetageunit")
    known = age.isNull() | F.coalesce(unit.isin(*ONSET_UNIT_LABELS), F.lit(False))
    counted = (
        docs.filter(known)
        .groupBy(onset_age_years(age, unit).alias("age"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.withColumn("age_group", age_group("age", unknown="Not reported"))


def nested_age_groups(docs: DataFrame) -> DataFrame:
    """Documents per age group, all seven present."""
    counts = nested_ages(docs).groupBy("age_group").agg(F.sum("n").alias("n"))
    return with_all_categories(counts, "age_group", [*AGE_GROUPS, "Not reported"])


def nested_age_histogram(docs: DataFrame, width: float = 2, hi: float = 100) -> DataFrame:
    """Documents per age bin and group up to ``hi`` years."""
    return age_bins(nested_ages(docs), "age", F.col("age_group"), width, hi, weight=F.col("n"))


def nested_age_excluded(docs: DataFrame, hi: float = 100) -> DataFrame:
    """Documents with an age above ``hi`` years."""
    return nested_ages(docs).filter(F.col("age") > hi).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def nested_vocabulary(docs: DataFrame, path: str, k: int | None = None, pattern: str = "[%,]") -> DataFrame:
    """All terms under a path without reserved characters, sorted; with ``k`` only the k most frequent."""
    terms = nested_counts(docs, path) if k is None else nested_top(docs, path, k)
    return drop_terms(terms, "term", pattern).select("term").orderBy("term")
