"""Scalar cleaning expressions for report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentria.functions.special import num

# Day-month-year layouts accepted for two- and four-digit years.
DATE_LAYOUTS = ("dd-MMM-yy", "d-MMM-yy", "dd-MM-yy", "d-M-yy", "dd/MM/yy", "dd-MMM-yyyy", "dd-MM-yyyy")

# Upper limits of the age groups, in years.
NEONATE_MAX = 25 / 365
AGE_GROUPS = ("Neonate", "Infant", "Child", "Adolescent", "Adult", "Elderly")

# Onset age unit codes and the years in one unit.
ONSET_UNIT_LABELS = {
    "800": "Decade",
    "801": "Year",
    "802": "Month",
    "803": "Week",
    "804": "Day",
    "805": "Hour",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_date(c: Column | str) -> Column:
    """Day-month-year text to a date; a year after 2050 belongs to the previous century.

    Unparseable text gives null. Month names are matched in any letter case.
    """
    text = F.trim(_col(c))
    parsed = F.coalesce(*[F.try_to_date(text, layout) for layout in DATE_LAYOUTS])
    return F.when(F.year(parsed) > 2050, F.add_months(parsed, -1200)).otherwise(parsed)


def add_clean_dates(t: DataFrame, columns: tuple[str, ...] = ("DATRECEIVED", "DATINTRECEIVED")) -> DataFrame:
    """Keep each text date and add ``<name>_CLEAN`` (date) and ``<name>_CHAR`` (text)."""
    added: dict[str, Column] = {}
    for name in columns:
        added[f"{name}_CLEAN"] = clean_date(name)
    t = t.withColumns(added)
    return t.withColumns({f"{name}_CHAR": F.col(f"{name}_CLEAN").cast("string") for name in columns})


def age_group(c: Column | str, unknown: str = "Unknown") -> Column:
    """Age group of an age in years; null ages get ``unknown``."""
    age = num(_col(c))
    return (
        F.when(age.isNull(), F.lit(unknown))
        .when(age <= NEONATE_MAX, F.lit("Neonate"))
        .when(age < 1, F.lit("Infant"))
        .when(age < 13, F.lit("Child"))
        .when(age < 18, F.lit("Adolescent"))
        .when(age <= 65, F.lit("Adult"))
        .when(age > 65, F.lit("Elderly"))
    )


def require_complete(t: DataFrame, column: str) -> DataFrame:
    """Raise ``ValueError`` when any row has no value in ``column``; else return ``t``."""
    missing = t.agg(F.count_if(F.col(column).isNull()).alias("n")).head()["n"]
    if missing:
        raise ValueError(f"{missing} rows have no {column}")
    return t


def checked_complete(t: DataFrame, column: str) -> DataFrame:
    """Same test inside the plan: the job fails at the first incomplete row, with no extra pass."""
    message = F.lit(f"a row has no {column}")
    return t.withColumn(
        column, F.when(F.col(column).isNull(), F.raise_error(message)).otherwise(F.col(column))
    )


def onset_age_years(age: Column | str, unit: Column | str) -> Column:
    """Onset age in years from a value and its unit code; other or missing units give null."""
    a, u = num(_col(age)), _col(unit).cast("string")
    return (
        F.when(u == "800", a * 10.0)
        .when(u == "801", a)
        .when(u == "802", a / 12.0)
        .when(u == "803", a / 52.0)
        .when(u == "804", a / 365.0)
        .when(u == "805", a / (365.0 * 24.0))
    )


def quarter_key(c: Column | str) -> Column:
    """Sortable quarter number ``year * 10 + quarter``."""
    d = _col(c)
    return (F.year(d) * 10 + F.quarter(d)).cast("long")


def quarter_label(key: Column | str) -> Column:
    """``YYYY.q`` label of a quarter key, for output only."""
    k = _col(key)
    return F.concat_ws(".", F.floor(k / 10).cast("string"), (k % 10).cast("string"))


def quarter_from_label(label: Column | str) -> Column:
    """Quarter key of a ``YYYY.q`` label or number."""
    return F.round(_col(label).cast("double") * 10).cast("long")


def quarter_start(key: Column | str) -> Column:
    """First day of the quarter with this key."""
    k = _col(key)
    return F.make_date(F.floor(k / 10).cast("int"), ((k % 10) * 3 - 2).cast("int"), F.lit(1))


def relabel(t: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replace the listed values of a column, keep the others."""
    return t.withColumn(column, recode(column, mapping))


def recode(c: Column | str, mapping: dict[str, str]) -> Column:
    """Replace the listed values, keep the others."""
    value = _col(c)
    out = value
    for old, new in mapping.items():
        out = F.when(value == old, F.lit(new)).otherwise(out)
    return out


def pad_id(c: Column | str, n: int = 9) -> Column:
    """Left-pad an id with zeros to ``n`` characters, never cutting it, and put a TAB before it."""
    text = _col(c).cast("string")
    return F.concat(F.lit("\t"), F.when(F.length(text) >= n, text).otherwise(F.lpad(text, n, "0")))


def norm_term(c: Column | str) -> Column:
    """Upper case for case-insensitive term matching."""
    return F.upper(_col(c))


def drop_terms(t: DataFrame, column: str, pattern: str = "[%,]") -> DataFrame:
    """Drop vocabulary terms with reserved characters; nulls go too."""
    return t.filter(~F.col(column).rlike(pattern))


def explode_ingredients(t: DataFrame, column: str = "ing") -> DataFrame:
    """Distinct single ingredients of ``|``-joined ingredient names."""
    return t.select(F.explode(F.split(F.col(column), r"\|")).alias(column)).distinct()


def round_numeric(t: DataFrame, places: int = 3) -> DataFrame:
    """Round every floating-point or decimal column; integers are unchanged by rounding."""
    kinds = (T.DoubleType, T.FloatType, T.DecimalType)
    names = [f.name for f in t.schema.fields if isinstance(f.dataType, kinds)]
    return t.withColumns({n: F.round(F.col(f"`{n}`"), places) for n in names})


def bucket_date(c: Column | str, unit: str) -> Column:
    """First day of the month or year."""
    if unit not in ("month", "year"):
        raise ValueError("unit must be 'month' or 'year'")
    return F.trunc(_col(c).cast("date"), unit)


def pair_label(drug: Column | str, event: Column | str) -> Column:
    """Series label of a pair."""
    return F.concat_ws("_", _col(drug), _col(event))
