"""Vocabularies and dependent choices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocabulary(t: DataFrame, *columns: str, clean: bool = False, ordered: bool = True) -> DataFrame:
    """Distinct non-null values of one or more columns, sorted, as ``term``.

    ``clean`` leaves out names that are no text: blank ones and those with control characters.
    """
    parts = [t.select(F.col(c).alias("term")) for c in columns]
    terms = reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("term").isNotNull()).distinct()
    if clean:
        terms = terms.filter(~F.col("term").rlike(r"\p{Cntrl}|^\s*$"))
    return terms.orderBy("term") if ordered else terms


def term_map(fact: DataFrame) -> DataFrame:
    """Distinct (ingredient, preferred term, high-level term, organ class) with a high-level term."""
    return (
        fact.filter(F.col("HLT_NAME_ENG").isNotNull())
        .select("ing", "PT_NAME_ENG", "HLT_NAME_ENG", "SOC_NAME_ENG")
        .distinct()
    )


def choices(
    mapping: DataFrame,
    column: str,
    drugs: Sequence[str] = (),
    hlts: Sequence[str] = (),
) -> DataFrame:
    """Sorted values of ``column`` that occur with the chosen drugs and high-level terms."""
    if drugs:
        mapping = mapping.filter(F.col("ing").isin(*drugs))
    if hlts:
        mapping = mapping.filter(F.col("HLT_NAME_ENG").isin(*hlts))
    return mapping.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
