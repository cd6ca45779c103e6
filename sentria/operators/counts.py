"""Distinct-report counts of (drug, event) pairs.

``N`` of the statistics is a sum over pairs, so every count here is a plain
two-step aggregate: duplicates go first, then ``count`` with partial sums on the
map side. A drug or event that holds a large share of all rows is shrunk by the
partial aggregates before anything is shuffled on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.operators.joins import report_cells

# Event column of a fact table per dictionary level.
LEVEL_COLUMNS = {
    "PT": "PT_NAME_ENG",
    "HLT": "HLT_NAME_ENG",
    "HLGT": "HLGT_NAME_ENG",
    "SOC": "SOC_NAME_ENG",
}


def level_column(level: str) -> str:
    return LEVEL_COLUMNS[level.upper()]


def analysis_cohort(fact: DataFrame, since: int = 20061, require_pt: bool = True) -> DataFrame:
    """Rows from quarter key ``since`` on, by default only those with a preferred term."""
    kept = fact.filter(F.col("quarter") >= since)
    return kept.filter(F.col("PT_NAME_ENG").isNotNull()) if require_pt else kept


def pair_counts(
    fact: DataFrame,
    level: str = "PT",
    by: str | None = None,
    drug: str = "ing",
    report: str = "REPORT_ID",
) -> DataFrame:
    """Distinct reports per (drug, event), optionally per ``by`` column.

    Above PT level, pairs without a term are dropped after grouping, which is
    the same set as dropping the rows before.
    """
    event = level_column(level)
    keys = ([by] if by else []) + [drug, event]
    rows = fact.select(report, *keys)
    if level.upper() != "PT":
        rows = rows.filter(F.col(event).isNotNull())
    distinct_reports = F.count(report).cast("long").alias("count")
    return rows.distinct().groupBy(*keys).agg(distinct_reports)


#: Pairs that a task forms of one report at a time; reports with more are cut into cells.
CELL_PAIRS = 1_000_000


def pair_counts_from_tables(
    drug_rows: DataFrame,
    reaction_rows: DataFrame,
    drug: str,
    event: str,
    report: str = "REPORT_ID",
    by: str | None = None,
    cell_pairs: int = CELL_PAIRS,
    tasks: int = 1,
) -> DataFrame:
    """Pair counts straight from report x drug and report x reaction rows.

    The joined fact is never formed and needs no distinct: a report contributes
    its distinct drugs x its distinct events, cut into cells of ``cell_pairs``
    pairs that go to different tasks, ``tasks`` of them at least (``joins.report_cells``). ``by``, a column of
    the drug rows that goes with the report (its quarter), gives separate counts.
    """
    keys = [by] if by else []
    met = report_cells(drug_rows, reaction_rows, report, drug, event, keys, cell_pairs, tasks=tasks)
    return met.groupBy(*keys, drug, event).agg(F.count(F.lit(1)).cast("long").alias("count"))


def fact_pair_counts(
    drug_rows: DataFrame, reaction_rows: DataFrame, drug: str, event: str, report: str = "REPORT_ID", tasks: int = 1
) -> DataFrame:
    """Distinct reports per (drug, event) of the left-joined fact, without forming it.

    As in the fact, null drugs and events are values, and a report without any
    reaction counts under a null event. Rows without a report fall out.
    """
    left = drug_rows.select(report, F.struct(drug).alias("_drug"))
    right = reaction_rows.select(report, F.struct(event).alias("_event"))
    cells = report_cells(left, right, report, "_drug", "_event", limit=CELL_PAIRS, outer=True, tasks=tasks)
    met = cells.select("_drug.*", "_event.*")
    return met.groupBy(drug, event).agg(F.count(F.lit(1)).alias("count"))


def pair_rows_from_tables(
    drug_rows: DataFrame,
    reaction_rows: DataFrame,
    drug: str,
    event: str,
    report: str = "REPORT_ID",
    by: str = "quarter",
    cell_pairs: int = CELL_PAIRS,
    tasks: int = 1,
) -> DataFrame:
    """Per (drug, event, ``by``) the distinct reports ``count`` and the rows ``n`` of the joined fact, without forming it.

    A report adds, per pair, its rows of the drug times its rows of the event. It has
    one value of ``by``, so sums of ``count`` over ``by`` are distinct reports too.
    """
    keys = [report, by, drug]
    drugs = drug_rows.select(*keys).na.drop().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    events = reaction_rows.select(report, event).na.drop().groupBy(report, event).agg(F.count(F.lit(1)).alias("n"))
    left = drugs.select(report, by, F.struct(drug, F.col("n").alias("_n")).alias("_drug"))
    right = events.select(report, F.struct(event, F.col("n").alias("_m")).alias("_event"))
    met = report_cells(left, right, report, "_drug", "_event", [by], cell_pairs, tasks=tasks).select(by, "_drug.*", "_event.*")
    return met.groupBy(drug, event, by).agg(
        F.count(F.lit(1)).cast("long").alias("count"), F.sum(F.col("_n") * F.col("_m")).alias("n")
    )


def pair_rows_by_quarter(fact: DataFrame, level: str = "PT", drug: str = "ing") -> DataFrame:
    """Fact rows (not distinct reports) per (drug, event, quarter)."""
    keys = [drug, level_column(level), "quarter"]
    return fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def quarters(counts: DataFrame) -> DataFrame:
    """Distinct quarters present."""
    return counts.select("quarter").distinct()


def report_total(t: DataFrame, report: str = "REPORT_ID") -> DataFrame:
    """Number of distinct reports, as one row."""
    return t.select(report).distinct().agg(F.count(report).alias("n_reports"))


def missing_count(t: DataFrame, path: str | Column) -> DataFrame:
    """Number of rows in which a field is missing, as one row."""
    c = F.col(path) if isinstance(path, str) else path
    return t.agg(F.count_if(c.isNull()).alias("n"))
