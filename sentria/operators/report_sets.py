"""Sets of reports as bitmaps: found once, combined, and used by any number of panels.

A set has one row per range of 64 neighbouring ids that holds a member: the number of
the range and a bit per id. That is a tenth or less of the ids themselves where a search
finds many, and no more than one row per id where it finds few. Sets meet on the range,
so intersections move ranges, not ids, and any table with the id is cut by one equi-join
and a bit test.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.operators import search
from sentria.session import cut_lineage

RANGE = "_range"
BITS = "_bits"


def _range(c: Column) -> Column:
    return F.shiftright(c.cast("long"), 6)


def _bit(c: Column) -> Column:
    # Shifts take the last six bits of the distance.
    return F.call_function("shiftleft", F.lit(1).cast("long"), c.cast("long").bitwiseAND(F.lit(63)).cast("int"))


@dataclass(frozen=True)
class ReportSet:
    """A set of whole-number ids; ``rows`` has each range at most once and no empty one."""

    rows: DataFrame
    report: str = search.REPORT

    @classmethod
    def of(cls, t: DataFrame, report: str = search.REPORT) -> ReportSet:
        """The ids in a table. Repeated ones go before anything is moved; null is no member."""
        c = F.col(report)
        rows = t.where(c.isNotNull()).groupBy(_range(c).alias(RANGE)).agg(F.bit_or(_bit(c)).alias(BITS))
        return cls(rows, report)

    def stored(self) -> ReportSet:
        """The same set, evaluated once and written; later uses read it only."""
        return ReportSet(cut_lineage(self.rows), self.report)

    def _with(self, other: ReportSet, how: str, bits: Column) -> ReportSet:
        mine = self.rows.withColumnRenamed(BITS, "_mine")
        theirs = other.rows.withColumnRenamed(BITS, "_theirs")
        joined = mine.join(theirs, RANGE, how).select(RANGE, bits.alias(BITS))
        return ReportSet(joined.where(F.col(BITS) != 0), self.report)

    def __and__(self, other: ReportSet) -> ReportSet:
        return self._with(other, "inner", F.col("_mine").bitwiseAND(F.col("_theirs")))

    def __sub__(self, other: ReportSet) -> ReportSet:
        kept = F.col("_mine").bitwiseAND(F.bitwise_not(F.coalesce("_theirs", F.lit(0).cast("long"))))
        return self._with(other, "left", kept)

    def __or__(self, other: ReportSet) -> ReportSet:
        rows = self.rows.unionByName(other.rows).groupBy(RANGE).agg(F.bit_or(BITS).alias(BITS))
        return ReportSet(rows, self.report)

    def count(self) -> DataFrame:
        """Number of members, as one row ``n_reports``."""
        return self.rows.agg(F.coalesce(F.sum(F.bit_count(BITS)), F.lit(0)).cast("long").alias("n_reports"))

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def members(self) -> DataFrame:
        """The ids, one row each."""
        first = F.shiftleft(F.col(RANGE), 6)
        here = F.filter(
            F.sequence(F.lit(0), F.lit(63)),
            lambda k: F.call_function("shiftright", F.col(BITS), k).bitwiseAND(F.lit(1)) == 1,
        )
        own = F.transform(here, lambda k: first + k.cast("long"))
        return self.rows.select(F.explode(own).alias(self.report))

    def of_rows(self, t: DataFrame) -> DataFrame:
        """The rows of a table whose id is a member."""
        c = F.col(self.report)
        held = (_range(c) == F.col(RANGE)) & (_bit(c).bitwiseAND(F.col(BITS)) != 0)
        return t.join(self.rows, held, "left_semi")


def search_set(tables: search.Tables, query: search.Query) -> ReportSet:
    """The reports of a search: the sets of its report, drug and reaction conditions, intersected."""
    found = [ReportSet.of(ids) for ids in search.conditions(tables, query)]
    out = found[0]
    for other in found[1:]:
        out = out & other
    return out
