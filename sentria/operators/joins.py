"""Joins and unions that enrich or reshape report tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.session import spread

# Codes of the nested reports and their labels.
REPORTER_CODES = {
    1: "Physician",
    2: "Pharmacist",
    3: "Other health professional",
    4: "Lawyer",
    5: "Consumer or non-health professional",
}
SEX_CODES = {0: "Unknown", 1: "Male", 2: "Female"}
OUTCOME_CODES = {
    1: "Recovered/resolved",
    2: "Recovering/resolving",
    3: "Not recovered/not resolved",
    4: "Recovered/resolved with sequelae (consequent health issues)",
    5: "Fatal",
    6: "Unknown",
}


def report_cells(
    left: DataFrame, right: DataFrame, key: str, one: str, two: str, carry: Sequence[str] = (), limit: int = 1_000_000,
    outer: bool = False, tasks: int = 1,
) -> DataFrame:
    """All combinations of the distinct ``one`` and ``two`` values of each key: ``carry``, ``one``, ``two``.

    Both sides become one row per key with the two sets of its values, by one
    aggregate over their union, duplicates going before the exchange; so nothing is
    sorted to be joined and no join multiplies rows. A key's combinations are
    then cut into a grid of cells of at most ``limit`` pairs, and cells, not keys, are
    dealt to the tasks that form the pairs, at least ``tasks``: let it follow the rows
    (``session.tasks_for``), since what a task counts of its pairs does. ``carry``, columns of the left rows, go
    with their ``one`` values. Null values and keys fall out; ``outer`` keeps a key
    without ``two`` values, with a null.
    """
    lefts = left.select(key, *carry, one).na.drop().select(key, F.struct(*carry, one).alias("_one"))
    rights = right.select(key, two).na.drop().withColumnRenamed(two, "_two")
    sets = (
        lefts.unionByName(rights, allowMissingColumns=True)
        .groupBy(key)
        .agg(F.collect_set("_one").alias("_one"), F.collect_set("_two").alias("_two"))
    )
    if outer:
        nothing = F.array(F.lit(None).cast(sets.schema["_two"].dataType.elementType))
        sets = sets.withColumn("_two", F.when(F.size("_two") > 0, F.col("_two")).otherwise(nothing))
    side = math.isqrt(limit)
    parts = lambda c: F.sequence(F.lit(0), F.ceil(F.size(c) / side).cast("int") - 1)
    piece = lambda c, k: F.slice(c, F.col(k) * side + 1, side)
    cells = (
        sets.filter((F.size("_one") > 0) & (F.size("_two") > 0))
        .withColumn("_row", F.explode(parts("_one")))
        .withColumn("_column", F.explode(parts("_two")))
        .select(key, "_row", "_column", piece("_one", "_row").alias("_one"), piece("_two", "_column").alias("_two"))
    )
    dealt = spread(cells, key, "_row", "_column", least=tasks)
    return dealt.select(F.explode("_one").alias("_one"), "_two").select("_one.*", F.explode("_two").alias(two))


def add_hierarchy(fact: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Add ``HLT_NAME_ENG`` and ``HLGT_NAME_ENG`` by preferred term and dictionary version.

    Only rows of the primary organ class join; facts without a match stay. The
    dictionary is not hinted: adaptive execution broadcasts it if it is small.
    """
    primary = hierarchy.filter(F.col("Primary_SOC_flag") == "Y").select(
        F.col("PT_Term").alias("PT_NAME_ENG"),
        "MEDDRA_VERSION",
        F.col("HLT_Term").alias("HLT_NAME_ENG"),
        F.col("HLGT_Term").alias("HLGT_NAME_ENG"),
    )
    plain = fact.drop("HLT_NAME_ENG", "HLGT_NAME_ENG")
    return plain.join(primary, ["PT_NAME_ENG", "MEDDRA_VERSION"], "left")


def build_fact(ingredients: DataFrame, drugs: DataFrame, reactions: DataFrame) -> DataFrame:
    """Report x ingredient x reaction rows: ingredients, then drugs, then reactions, left-joined.

    Use ``counts.pair_counts_from_tables`` when only distinct counts are wanted:
    it never forms these rows.
    """
    products = ingredients.select("DRUG_PRODUCT_ID", "ACTIVE_INGREDIENT_NAME")
    used = drugs.select("DRUG_PRODUCT_ID", "REPORT_ID")
    terms = reactions.select("REPORT_ID", "PT_NAME_ENG")
    return (
        products.join(used, "DRUG_PRODUCT_ID", "left")
        .join(terms, "REPORT_ID", "left")
        .select("REPORT_ID", "ACTIVE_INGREDIENT_NAME", "PT_NAME_ENG")
    )


def in_reports(t: DataFrame, reports: DataFrame, lo, hi, column: str = "DATINTRECEIVED_CLEAN") -> DataFrame:
    """Rows of reports received between two dates, both included."""
    chosen = reports.filter(F.col(column).between(F.lit(lo), F.lit(hi))).select("REPORT_ID")
    return t.join(chosen, "REPORT_ID", "left_semi")


def semi_keys(t: DataFrame, keys: DataFrame, on: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Rows whose key columns occur in ``keys``; ``on`` maps columns of ``t`` to those of ``keys``."""
    pairs = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    renamed = keys.select(*[F.col(theirs).alias(ours) for ours, theirs in pairs.items()])
    return t.join(renamed, list(pairs), "left_semi")


def category_dimension(t: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """An ordered category list as rows ``(column, position)``."""
    rows = [(name, i) for i, name in enumerate(order)]
    return t.sparkSession.createDataFrame(rows, f"`{column}` string, position int")


def with_all_categories(counts: DataFrame, column: str, order: Sequence[str], value: str = "n") -> DataFrame:
    """One row per category of ``order``, zero where absent, with its ``position``."""
    return (
        category_dimension(counts, column, order)
        .join(counts.select(column, value), column, "left")
        .na.fill(0, [value])
    )


def densify(pairs: DataFrame, quarter_list: DataFrame, counts: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    """Counts of the given pairs in every quarter, zero where absent.

    The quarters (a calendar: four a year) ride along as one array literal that
    is exploded per pair, so pairs are neither shuffled nor cross-joined.
    """
    calendar = quarter_list.agg(F.sort_array(F.collect_set("quarter"))).scalar()
    grid = pairs.select(*keys).distinct().withColumn("quarter", F.explode(calendar))
    known = counts.groupBy(*keys, "quarter").agg(F.sum(value).alias(value))
    return grid.join(known, [*keys, "quarter"], "left").na.fill(0, [value])


def decode(c: Column | str, codes: Mapping[int, str]) -> Column:
    """Label of a code; null for codes not in the list."""
    value = F.col(c) if isinstance(c, str) else c
    pairs = [F.lit(x) for code, label in codes.items() for x in (code, label)]
    return F.try_element_at(F.create_map(*pairs), value.cast("int"))


def master_table(*stats: DataFrame) -> DataFrame:
    """Merge statistic tables by pair; columns already present are not repeated."""

    def merge(left: DataFrame, right: DataFrame) -> DataFrame:
        keys = ["drug_code", "event_effect"]
        fresh = [c for c in right.columns if c not in left.columns]
        return left.join(right.select(*keys, *fresh), keys)

    return reduce(merge, stats)


def union_versions(tables: Sequence[DataFrame]) -> DataFrame:
    """All dictionary versions in one table, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def stack_labelled(tables: Mapping[str, DataFrame], label: str = "label") -> DataFrame:
    """Frames of equal columns on top of each other, with the name of the source."""
    return union_versions([t.withColumn(label, F.lit(name)) for name, t in tables.items()])


def coverage(names: DataFrame, catalogues: Mapping[str, DataFrame], column: str = "ing") -> DataFrame:
    """Distinct names with ``found``: whether any catalogue (one column each) has the name.

    Names and catalogues are compared in upper case.
    """
    known = union_versions(
        [c.select(F.upper(F.col(c.columns[0])).alias("_key")) for c in catalogues.values()]
    ).distinct()
    listed = names.select(column).distinct().withColumn("_key", F.upper(column))
    return (
        listed.join(known.withColumn("found", F.lit(True)), "_key", "left")
        .na.fill(False, ["found"])
        .drop("_key")
    )


def merge_series(parts: Mapping[str, DataFrame], date: str = "time_p", value: str = "n") -> DataFrame:
    """Several bucketed series side by side: a row for every bucket of any of them, 0 where one has none.

    The same rows as full outer joins on the bucket, by one aggregate over all parts.
    A series may have several rows per bucket; they add up.
    """
    stacked = reduce(
        DataFrame.unionByName,
        [t.select(date, F.col(value).alias("_value"), F.lit(name).alias("_part")) for name, t in parts.items()],
    )
    of = lambda name: F.sum(F.when(F.col("_part") == name, F.col("_value")).otherwise(0))
    return stacked.groupBy(date).agg(*[of(name).alias(name) for name in parts])
