"""Signal detection from a fact table to the master table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.operators.bayes import bcpnn, bcpnn_mc
from sentria.operators.contingency import contingency
from sentria.operators.counts import level_column, pair_counts
from sentria.operators.disproportionality import cells, prr, rfet, ror, rrr
from sentria.operators.series import signal_order
from sentria.operators.shrinkage import GammaMixture, gps
from sentria.session import settle

# Names of the cell columns in result tables.
RESULT_NAMES = {"n11": "count", "n1_": "drug_margin", "n_1": "event_margin"}
_CELLS = ("n10", "n01", "n00")


def standardise(stats: DataFrame) -> DataFrame:
    """Result-table column names, without the helper cells."""
    return stats.drop(*_CELLS).withColumnsRenamed(RESULT_NAMES)


def all_statistics(
    ct: DataFrame,
    exact: bool = True,
    draws: int | None = None,
    seed: int = 0,
    prior: GammaMixture | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Every statistic on one frame, without joins.

    The component is in natural units, closed form (its posterior median is its
    mean) unless ``draws`` asks for sampling. ``prior`` adds the shrinkage columns. Rows are
    repartitioned once for the Arrow steps.
    """
    t = rrr(ror(prr(cells(ct))))
    if exact:
        t = rfet(t)
    if draws:
        t = bcpnn_mc(t, draws=draws, seed=seed)
    else:
        t = bcpnn(t, log_base=math.e).withColumnRenamed("IC", "median_IC").drop("var_IC")
    if prior is not None:
        t = gps(t.withColumnRenamed("postH0", "_ic_h0"), prior).drop("Q", "n11_over_E")
        t = t.withColumnsRenamed({"postH0": "gps_postH0", "_ic_h0": "postH0"})
    return standardise(t)


def signals(
    fact: DataFrame,
    level: str = "PT",
    by: str | None = None,
    drug: str = "ing",
    ordered: bool = True,
    min_margin: int = 1,
    **options,
) -> DataFrame:
    """Master table of a cohort: one row per pair, leading signals first.

    With ``by`` (a quarter column) each quarter has its own contingency table;
    all quarters run in one plan.
    """
    counts = pair_counts(fact, level, by=by, drug=drug)
    return signals_from_counts(counts, drug, level_column(level), by, ordered, min_margin, **options)


def signals_from_counts(
    counts: DataFrame,
    drug: str,
    event: str,
    by: str | None = None,
    ordered: bool = True,
    min_margin: int = 1,
    **options,
) -> DataFrame:
    """Master table of pair counts, which need no fact table (``counts.pair_counts_from_tables``)."""
    groups = (by,) if by else ()
    ct = contingency(counts, drug, event, by=groups, min_margin=min_margin)
    table = all_statistics(ct, by=groups, **options)
    if not ordered:
        return table
    # A global sort samples its input first. Behind this exchange the sample reads
    # shuffle files instead of running the exact test or the draws twice.
    settled = settle(table, *groups, "drug_code", "event_effect")
    return settled.orderBy(*groups, *signal_order())


def carried(t: DataFrame, keys: list[str], value: str, calendar: Column, last: Column) -> DataFrame:
    """The value of every key in every quarter from its first on; gaps take the one before.

    Each sparse row (``_pos`` is its place in the calendar) is repeated up to the
    quarter before the next one of the same key, so the dense rows come from an
    explode, not from a cross join. A key has at most one row per quarter.
    """
    until = F.coalesce(F.lead("_pos").over(W.partitionBy(*keys).orderBy("_pos")), last + 1) - 1
    return (
        t.withColumn("_until", until)
        .withColumn("_pos", F.explode(F.sequence("_pos", "_until")))
        .withColumn("quarter", F.element_at(calendar, F.col("_pos").cast("int")))
        .select("quarter", *keys, value)
    )


def _carried(t: DataFrame, keys: list[str], value: str, calendar: Column, last: Column) -> DataFrame:
    """Running total per key in every quarter from its first on."""
    upto = W.partitionBy(*keys).orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return carried(t.withColumn(value, F.sum(value).over(upto)), keys, value, calendar, last)


def cumulative_contingency(counts: DataFrame, drug: str, event: str, count: str = "count") -> DataFrame:
    """Contingency up to and including each quarter.

    ``counts`` has one row per (quarter, drug, event). Totals carry over quarters
    in which the pair is absent, and N is cumulative too. Pairs appear from the
    first quarter in which they occur.
    """
    rows = counts.filter(F.col(drug).isNotNull() & F.col(event).isNotNull()).select(
        "quarter",
        F.col(drug).alias("drug_code"),
        F.col(event).alias("event_effect"),
        F.col(count).cast("long").alias("n11"),
    )
    rows = settle(rows, "event_effect", "drug_code", "quarter")
    # A calendar of the quarters present: four entries a year. Reading the count
    # too keeps its input the same exchange as that of the rows.
    present = F.when(F.col("n11") > 0, F.col("quarter"))
    calendar = rows.agg(F.sort_array(F.collect_set(present))).scalar()
    last = F.size(calendar)
    placed = rows.withColumn("_pos", F.array_position(calendar, F.col("quarter")))
    pairs = _carried(placed, ["drug_code", "event_effect"], "n11", calendar, last)
    drugs = placed.groupBy("_pos", "drug_code").agg(F.sum("n11").alias("n1_"))
    events = placed.groupBy("_pos", "event_effect").agg(F.sum("n11").alias("n_1"))
    totals = placed.groupBy("_pos").agg(F.sum("n11").alias("N")).withColumn("_all", F.lit(0))
    return (
        pairs.join(_carried(drugs, ["drug_code"], "n1_", calendar, last), ["quarter", "drug_code"])
        .join(_carried(events, ["event_effect"], "n_1", calendar, last), ["quarter", "event_effect"])
        .join(_carried(totals, ["_all"], "N", calendar, last).drop("_all"), "quarter")
        .select("quarter", "drug_code", "event_effect", "n11", "n1_", "n_1", "N")
    )


def cumulative_ic(stats: DataFrame, ic: str = "median_IC", lower: str = "LB95_IC") -> DataFrame:
    """Running sums of the component and its lower bound by pair over the quarters."""
    upto = (
        W.partitionBy("drug_code", "event_effect")
        .orderBy("quarter")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return stats.withColumns(
        {"IC_cumulative": F.sum(ic).over(upto), "LB95_IC_cumulative": F.sum(lower).over(upto)}
    )
