"""Cohort search: conditions on reports, drugs and reactions, and their combination.

Conditions are Columns, so they reach the scan; conditions through another
table are left-semi joins. Everything is conjunctive, and an empty selection
means "no filter".
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.session import cut_lineage

REPORT = "REPORT_ID"
SERIOUS_NO_DEATH = "Serious(Excluding Death)"


def in_period(
    lo: dt.date, hi: dt.date, whole_months: bool = False, column: str = "DATINTRECEIVED_CLEAN"
) -> Column:
    """Date window with both ends moved to the first of their month.

    The default keeps an inclusive upper end, so of the last month only day 1
    matches; if both ends have the same month of the year, the end is first moved
    by one day. ``whole_months=True`` takes the last month in full.
    """
    first = lo.replace(day=1)
    c = F.col(column)
    if whole_months:
        nxt = (hi.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
        return (c >= F.lit(first)) & (c < F.lit(nxt))
    if lo.month == hi.month:
        hi = hi + dt.timedelta(days=1)
    return c.between(F.lit(first), F.lit(hi.replace(day=1)))


def serious_is(kind: str = "All") -> Column | None:
    """Seriousness condition: ``All``, ``Death`` or serious without death."""
    if kind == "Death":
        return F.col("DEATH") == 1
    if kind == SERIOUS_NO_DEATH:
        return (F.col("SERIOUSNESS_ENG") == "Yes") & (F.col("DEATH").isNull() | (F.col("DEATH") == 2))
    return None


def gender_is(gender: str | None) -> Column | None:
    """Male or Female; any other value is no filter."""
    return F.col("GENDER_ENG") == gender if gender in ("Male", "Female") else None


def age_between(lo: float = 0, hi: float = 100, open_top: bool = False) -> Column:
    """Age range; the upper end goes when it is 100 and ``open_top``. Null ages never match."""
    age = F.col("AGE_Y")
    return age >= lo if open_top and hi == 100 else age.between(lo, hi)


def brand_in(names: Sequence[str]) -> Column | None:
    return F.col("DRUGNAME").isin(*names) if names else None


def involvement_is(kind: str = "Any") -> Column | None:
    return F.col("DRUGINVOLV_ENG") == kind if kind != "Any" else None


def has_term() -> Column:
    """Reactions with a non-blank preferred term."""
    return F.col("PT_NAME_ENG") != ""


def reaction_is(terms: Sequence[str]) -> Column | None:
    """Preferred term or standardised query in the list."""
    return F.col("PT_NAME_ENG").isin(*terms) | F.col("SMQ").isin(*terms) if terms else None


def soc_in(terms: Sequence[str]) -> Column | None:
    return F.col("SOC_NAME_ENG").isin(*terms) if terms else None


def where(t: DataFrame, *conditions: Column | None) -> DataFrame:
    """All conditions that are set."""
    for c in conditions:
        if c is not None:
            t = t.filter(c)
    return t


def ingredient_in(drugs: DataFrame, ingredients: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drug rows whose product has one of the ingredients."""
    if not names:
        return drugs
    products = ingredients.filter(F.col("ACTIVE_INGREDIENT_NAME").isin(*names))
    return drugs.join(products.select("DRUG_PRODUCT_ID"), "DRUG_PRODUCT_ID", "left_semi")


def substance_is(drugs: DataFrame, substances: DataFrame, name: str | None) -> DataFrame:
    """Drug rows whose name the substance dictionary lists for the ingredient."""
    if not name:
        return drugs
    related = substances.filter(F.col("ing") == name).select("DRUGNAME")
    return drugs.join(related, "DRUGNAME", "left_semi")


def reaction_in(reactions: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Distinct reaction rows with a term or standardised query of the list."""
    kept = where(reactions, has_term(), reaction_is(terms))
    return kept.distinct() if terms else kept


def attach_flags(t: DataFrame, reports: DataFrame) -> DataFrame:
    """Add each report's seriousness and death flags to drug or reaction rows."""
    flags = reports.select(REPORT, "SERIOUSNESS_ENG", "DEATH")
    return t.join(flags, REPORT, "left")


@dataclass(frozen=True)
class Query:
    """A report search. Unset fields do not filter."""

    lo: dt.date | None = None
    hi: dt.date | None = None
    whole_months: bool = False
    seriousness: str = "All"
    gender: str = "All"
    age: tuple[float, float] = (0, 100)
    over_100: bool = False
    brands: Sequence[str] = field(default_factory=tuple)
    ingredients: Sequence[str] = field(default_factory=tuple)
    substance: str | None = None
    involvement: str = "Any"
    reactions: Sequence[str] = field(default_factory=tuple)
    socs: Sequence[str] = field(default_factory=tuple)


@dataclass(frozen=True)
class Tables:
    """The report tables; the two dictionaries only if searched by ingredient."""

    reports: DataFrame
    drugs: DataFrame
    reactions: DataFrame
    ingredients: DataFrame | None = None
    substances: DataFrame | None = None


def conditions(tables: Tables, query: Query) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids that pass the conditions on reports, on drug rows and on reaction rows; the latter two may repeat.

    The seriousness condition of drug and reaction rows is that of their report,
    and every id comes from ``reports``, so it is tested once there instead of
    on three tables.
    """
    period = None
    if query.lo is not None and query.hi is not None:
        period = in_period(query.lo, query.hi, query.whole_months)
    ids = where(
        tables.reports,
        period,
        serious_is(query.seriousness),
        gender_is(query.gender),
        age_between(*query.age, open_top=query.over_100),
    ).select(REPORT)

    drugs = where(tables.drugs, brand_in(query.brands), involvement_is(query.involvement))
    if query.ingredients:
        drugs = ingredient_in(drugs, tables.ingredients, query.ingredients)
    if query.substance:
        drugs = substance_is(drugs, tables.substances, query.substance)
    reactions = where(tables.reactions, has_term(), reaction_is(query.reactions), soc_in(query.socs))
    return ids, drugs.select(REPORT), reactions.select(REPORT)


def search_reports(tables: Tables, query: Query) -> DataFrame:
    """Ids of the reports that pass, with a matching drug row and a matching reaction row.

    Drug and reaction ids are made distinct first: a report with very many rows
    shrinks on the map side, and the semi-joins reuse the partitioning of that
    step. For several panels of one search use ``report_sets.search_set``.
    """
    ids, drugs, reactions = conditions(tables, query)
    return ids.join(drugs.distinct(), REPORT, "left_semi").join(reactions.distinct(), REPORT, "left_semi")


def is_empty(t: DataFrame) -> bool:
    """True when a search found nothing; reads no more than one row."""
    return t.isEmpty()


def restrict(t: DataFrame, ids: DataFrame, empty_means_all: bool = True) -> DataFrame:
    """Rows of the selected reports; all rows if the selection is empty.

    With ``empty_means_all`` the selection is evaluated once and written, as both
    the test and the join read it.
    """
    if empty_means_all:
        ids = cut_lineage(ids.select(REPORT))
        if is_empty(ids):
            return t
    return t.join(ids.select(REPORT), REPORT, "left_semi")


def filter_signals(
    t: DataFrame,
    drugs: Sequence[str] = (),
    events: Sequence[str] = (),
    min_count: float | None = 0,
    min_exp: float | None = 0,
    drop_inf: bool = False,
) -> DataFrame:
    """Rows of a signal table; missing or negative minima count as 0, the count minimum is floored."""
    floor_count = int(min_count) if min_count is not None and min_count > 0 else 0
    floor_exp = float(min_exp) if min_exp is not None and min_exp > 0 else 0.0
    return where(
        t,
        F.col("drug_code").isin(*drugs) if drugs else None,
        F.col("event_effect").isin(*events) if events else None,
        F.col("PRR") != float("inf") if drop_inf else None,
        F.col("count") >= floor_count,
        F.col("expected_count") >= floor_exp,
    )
