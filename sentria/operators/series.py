"""Quarterly series of pairs and queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.functions.cleaning import pair_label
from sentria.operators.counts import level_column, quarters
from sentria.operators.joins import densify
from sentria.session import cut_lineage

TOTAL_LABEL = "total for query"


def signal_order() -> list:
    """Sort of a signal table: strongest component first, nulls ahead as in the original store."""
    return [
        F.col("median_IC").desc_nulls_first(),
        F.col("LB95_IC").desc_nulls_first(),
        F.col("drug_code").asc(),
        F.col("event_effect").asc(),
    ]


def pair_series(
    signals: DataFrame,
    counts: DataFrame,
    level: str = "PT",
    k: int = 10,
    drug: str = "ing",
    quarter_list: DataFrame | None = None,
) -> DataFrame:
    """Quarterly rows of the k leading pairs of a signal table, with zeros: ``label, quarter, n``.

    Give ``quarter_list`` when ``counts`` is not a stored table: the semi-join
    below then reaches the scan and only the rows of the leading pairs are counted.
    """
    event = level_column(level)
    # At most k rows by construction: safe to broadcast. They are used twice, so
    # the signal table is evaluated once and only its k leading keys are kept.
    leading = cut_lineage(
        signals.orderBy(*signal_order())
        .limit(k)
        .select(F.col("drug_code").alias(drug), F.col("event_effect").alias(event))
    )
    wanted = counts.join(F.broadcast(leading), [drug, event], "left_semi")
    present = quarters(counts) if quarter_list is None else quarter_list
    dense = densify(leading, present, wanted, [drug, event])
    return dense.select(pair_label(drug, event).alias("label"), "quarter", "n")


def total_series(counts: DataFrame, drugs: Sequence[str] = (), drug: str = "ing") -> DataFrame:
    """Quarterly total of the chosen drugs (of all if none)."""
    rows = counts.filter(F.col(drug).isin(*drugs)) if drugs else counts
    return (
        rows.groupBy("quarter")
        .agg(F.sum("n").alias("n"))
        .select(F.lit(TOTAL_LABEL).alias("label"), "quarter", "n")
    )
