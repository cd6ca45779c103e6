"""Quarterly counts kept as a table: a new quarter is added without reading earlier reports.

One table, partitioned by quarter, holds the reports ``n`` of every pair, drug and event
of a quarter and of the quarter as a whole (a null drug or event stands for all of them),
and ``running``, the number up to the quarter. A row exists only for quarters in which
its key occurs. Adding a quarter looks up the running numbers of its own keys and writes
one partition; a mark written last makes it visible. A load that failed half-way is
simply done again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentria.plans.signals import all_statistics, carried
from sentria.session import cut_lineage

PAIR = ["drug_code", "event_effect"]
_MARKS = T.StructType([T.StructField("done", T.BooleanType()), T.StructField("quarter", T.LongType())])


def _both(t: DataFrame, other: DataFrame) -> Column:
    """Equal pairs, nulls included."""
    return t["drug_code"].eqNullSafe(other["drug_code"]) & t["event_effect"].eqNullSafe(other["event_effect"])


def _is_pair() -> Column:
    return F.col("drug_code").isNotNull() & F.col("event_effect").isNotNull()


class QuarterStore:
    """Counts, running margins and scores of quarters in a folder that all executors share.

    One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: T.StructType | None = None) -> DataFrame | None:
        """A stored table, or None before the first write."""
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        try:
            return reader.parquet(f"{self.root}/{name}").withColumn("quarter", F.col("quarter").cast("long"))
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _write(self, t: DataFrame, name: str) -> None:
        writer = t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("quarter").parquet(f"{self.root}/{name}")

    def _mark(self, name: str, quarters: Sequence[int]) -> None:
        self._write(self.spark.createDataFrame([(True, q) for q in quarters], _MARKS).coalesce(1), name)

    def _marked(self, name: str) -> list[int]:
        # One row per quarter.
        t = self._table(name, _MARKS)
        return [] if t is None else sorted(r.quarter for r in t.collect())

    def quarters(self) -> list[int]:
        """The quarters that are loaded, in order."""
        return self._marked("loaded")

    def _counts(self, only: Sequence[int] | None = None) -> DataFrame:
        """Rows of the loaded quarters, or of some of them; other partitions are not read."""
        visible = [q for q in self.quarters() if only is None or q in only]
        t = self._table("counts")
        if t is None or not visible:
            raise ValueError(f"no such quarters in {self.root}")
        return t.filter(F.col("quarter").isin(visible))

    def pairs(self, only: Sequence[int] | None = None) -> DataFrame:
        """quarter, drug_code, event_effect, n11 of the loaded quarters, or of some of them."""
        return self._counts(only).filter(_is_pair()).select("quarter", *PAIR, F.col("n").alias("n11"))

    # Loading

    def _last(self, loaded: list[int]) -> DataFrame | None:
        """Rows among which is the last running number of every key: a compacted state and the quarters after it."""
        if not loaded:
            return None
        compacted = [q for q in self._marked("compacted") if q in loaded]
        recent = [q for q in loaded if not compacted or q > compacted[-1]]
        columns = [*PAIR, "running"]
        rows = self._table("counts").filter(F.col("quarter").isin(recent)).select(*columns)
        if compacted:
            rows = rows.unionByName(self._table("state").filter(F.col("quarter") == compacted[-1]).select(*columns))
        return rows

    def load(self, counts: DataFrame, drug: str, event: str, count: str = "count") -> list[int]:
        """Add quarters from their pair counts (``quarter``, drug, event, count) and return them.

        One quarter or a whole history; all must come after the quarters that are
        loaded. Rows without quarter, drug or event fall out. ``counts`` is evaluated once.
        """
        new = cut_lineage(
            counts.select(
                F.col("quarter").cast("long").alias("quarter"),
                F.col(drug).alias("drug_code"),
                F.col(event).alias("event_effect"),
                F.col(count).cast("long").alias("n"),
            ).na.drop()
        )
        found = sorted(r.quarter for r in new.select("quarter").distinct().collect())
        loaded = self.quarters()
        if found and loaded and found[0] <= loaded[-1]:
            raise ValueError(f"quarter {found[0]} is not after {loaded[-1]}")
        if not found:
            return []
        rows = new
        for keys in (["drug_code"], ["event_effect"], []):
            sums = new.groupBy("quarter", *keys).agg(F.sum("n").alias("n"))
            rows = rows.unionByName(sums, allowMissingColumns=True)
        upto = W.partitionBy(*PAIR).orderBy("quarter").rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = rows.withColumn("running", F.sum("n").over(upto))
        last = self._last(loaded)
        if last is not None:
            touched = rows.select(*PAIR).distinct()
            wanted = last.join(touched, _both(last, touched), "left_semi")
            # Running numbers never fall: the largest is the last.
            before = wanted.groupBy(*PAIR).agg(F.max("running").alias("_before"))
            joined = rows.join(before, _both(rows, before), "left").drop(before["drug_code"], before["event_effect"])
            rows = joined.withColumn("running", F.col("running") + F.coalesce("_before", F.lit(0))).drop("_before")
        self._write(rows, "counts")
        self._mark("loaded", found)
        return found

    def compact(self) -> None:
        """Write the last running number of every key, so that later loads read it and newer quarters only."""
        loaded = self.quarters()
        if loaded:
            state = self._last(loaded).groupBy(*PAIR).agg(F.max("running").alias("running"))
            self._write(state.withColumn("quarter", F.lit(loaded[-1])), "state")
            self._mark("compacted", loaded[-1:])

    # Contingency

    def _joined(self, t: DataFrame, value: str, widen=lambda rows, keys, value: rows) -> DataFrame:
        """Pairs with the margins and total of their quarter, all of them stored rows."""
        out = t.filter(_is_pair()).select("quarter", *PAIR, F.col(value).alias("n11"))
        out = widen(out, PAIR, "n11")
        drug, event = F.col("drug_code"), F.col("event_effect")
        for keys, name, rows in (
            (["drug_code"], "n1_", drug.isNotNull() & event.isNull()),
            (["event_effect"], "n_1", drug.isNull() & event.isNotNull()),
            ([], "N", drug.isNull() & event.isNull()),
        ):
            margin = t.filter(rows).select("quarter", *keys, F.col(value).alias(name))
            out = out.join(widen(margin, keys, name), ["quarter", *keys])
        return out.select("quarter", *PAIR, "n11", "n1_", "n_1", "N")

    def contingency(self, only: Sequence[int] | None = None) -> DataFrame:
        """The independent contingency table of each quarter."""
        return self._joined(self._counts(only), "n")

    def changed(self, only: Sequence[int] | None = None) -> DataFrame:
        """Running contingency, up to each quarter, of the pairs that occur in it.

        A pair that occurs changes its drug's and its event's margin, so all of it lies in the quarter's partition.
        """
        return self._joined(self._counts(only), "running")

    def cumulative_contingency(self) -> DataFrame:
        """Running contingency up to each quarter of all pairs seen so far."""
        loaded = self.quarters()
        calendar, last = F.array(*[F.lit(q) for q in loaded]), F.lit(len(loaded))

        def widen(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
            placed = rows.withColumn("_pos", F.array_position(calendar, F.col("quarter"))).drop("quarter")
            if keys:
                return carried(placed, keys, value, calendar, last)
            # One row per quarter.
            return carried(placed.withColumn("_all", F.lit(0)), ["_all"], value, calendar, last).drop("_all")

        return self._joined(self._counts(), "running", widen)

    # Scores

    def score(self, **options) -> list[int]:
        """Score the quarters that are loaded and not scored yet; only their pairs are touched.

        ``options`` go to ``signals.all_statistics``. ``IC_cumulative`` and
        ``LB95_IC_cumulative`` are sums over a pair's quarters.
        """
        marks = self._marked("scored")
        todo = [q for q in self.quarters() if q not in marks]
        if not todo:
            return []
        fresh = cut_lineage(all_statistics(self.contingency(todo), by=("quarter",), **options))
        upto = W.partitionBy(*PAIR).orderBy("quarter").rowsBetween(W.unboundedPreceding, W.currentRow)
        sums = {"IC_cumulative": "median_IC", "LB95_IC_cumulative": "LB95_IC"}
        out = fresh.withColumns({name: F.sum(c).over(upto) for name, c in sums.items()})
        if marks:
            known = self._table("scores").filter(F.col("quarter").isin(marks)).join(fresh.select(*PAIR).distinct(), PAIR, "left_semi")
            last = known.groupBy(*PAIR).agg(*[F.max_by(name, "quarter").alias(f"_{name}") for name in sums])
            out = out.join(last, PAIR, "left")
            out = out.withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0.0)) for n in sums}).drop(*[f"_{n}" for n in sums])
        self._write(out, "scores")
        self._mark("scored", todo)
        return todo

    def scores(self, only: Sequence[int] | None = None) -> DataFrame:
        """Scores of the pairs of each scored quarter."""
        chosen = [q for q in self._marked("scored") if only is None or q in only]
        if not chosen:
            raise ValueError(f"nothing is scored in {self.root}")
        return self._table("scores").filter(F.col("quarter").isin(chosen))
