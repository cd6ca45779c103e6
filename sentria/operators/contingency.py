"""Contingency margins of pair counts.

Margins and the grand total always come from the whole set of counts. Subset
pairs only afterwards: filtering first changes every statistic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.session import cut_lineage, new_shared_path, settle


def _with_margins(counts: DataFrame, by: list[str]) -> DataFrame:
    # Partial sums shrink a hot drug or event on the map side. The margin tables
    # have vocabulary size; adaptive execution broadcasts them only if their
    # measured size allows and otherwise splits skewed sort-merge partitions.
    drug = counts.groupBy(*by, "drug_code").agg(F.sum("n11").alias("n1_"))
    event = counts.groupBy(*by, "event_effect").agg(F.sum("n11").alias("n_1"))
    out = counts.join(drug, [*by, "drug_code"]).join(event, [*by, "event_effect"])
    if by:
        total = counts.groupBy(*by).agg(F.sum("n11").alias("N"))
        return out.join(total, by)
    return out.withColumn("N", counts.agg(F.sum("n11")).scalar())


def contingency(
    counts: DataFrame,
    drug: str,
    event: str,
    count: str = "count",
    by: Sequence[str] = (),
    min_margin: int = 1,
) -> DataFrame:
    """One row per pair: ``drug_code, event_effect, n11, n1_, n_1, N`` (and ``by``).

    Pairs with a null drug or event fall out before the totals are formed. With
    ``min_margin`` above 1, drugs and events whose margin is too small are
    removed and the margins lowered until nothing changes.
    """
    by = list(by)
    base = (
        counts.filter(F.col(drug).isNotNull() & F.col(event).isNotNull())
        .select(
            *by,
            F.col(drug).alias("drug_code"),
            F.col(event).alias("event_effect"),
            F.col(count).cast("long").alias("n11"),
        )
    )
    columns = [*by, "drug_code", "event_effect", "n11", "n1_", "n_1", "N"]
    if min_margin <= 1:
        # Both margins, the total and the pairs themselves read the same counts. Laid
        # out by drug, they give the drug margin and its join without another exchange.
        return _with_margins(settle(base, *by, "drug_code"), by).select(*columns)
    return _peeled(base, by, min_margin).select(*columns)


def _stored_by(t: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Pairs written in buckets of a key, so that the pairs of some keys are found without reading all."""
    spark = t.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_shared_path(spark, name)
    placed = t.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    placed.repartition("_bucket").write.partitionBy("_bucket").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def _peeled(base: DataFrame, by: list[str], min_margin: int) -> DataFrame:
    """Pairs and margins after drugs and events below a margin are removed until none is left.

    The margins are kept as state. A round finds the pairs of the keys that have
    become too small, in the buckets of these keys, and subtracts them from the
    margins on the other side; pairs that stay are neither read nor moved again
    before the end. State and removed pairs are checkpointed, so every round has a
    short plan and survives lost executors.
    """
    sides = {"n1_": [*by, "drug_code"], "n_1": [*by, "event_effect"]}
    pairs, stored = base, {}
    for margin, keys in sides.items():
        pairs = stored[margin] = _stored_by(pairs.drop("_bucket"), keys, f"pairs-{margin}")
    margins = {m: cut_lineage(stored[m].groupBy(*keys, "_bucket").agg(F.sum("n11").alias(m))) for m, keys in sides.items()}
    while True:
        weak = {m: margins[m].filter(F.col(m) < min_margin) for m in sides}
        # At most as many numbers as there are buckets.
        found = {m: [r[0] for r in weak[m].select("_bucket").distinct().collect()] for m in sides}
        if not any(found.values()):
            break
        strong = {m: margins[m].filter(F.col(m) >= min_margin) for m in sides}
        # Pairs that are still there: of a weak drug with any event left, of a weak event with a strong drug.
        others = {"n1_": margins["n_1"], "n_1": strong["n1_"]}
        gone = []
        for m, other in (("n1_", "n_1"), ("n_1", "n1_")):
            rows = stored[m].filter(F.col("_bucket").isin(found[m])).drop("_bucket")
            gone.append(
                rows.join(weak[m].select(*sides[m]), sides[m], "left_semi").join(
                    others[m].select(*sides[other]), sides[other], "left_semi"
                )
            )
        removed = cut_lineage(gone[0].unionByName(gone[1]))
        for m, keys in sides.items():
            less = removed.groupBy(*keys).agg(F.sum("n11").alias("_less"))
            left = strong[m].join(less, keys, "left").withColumn(m, F.col(m) - F.coalesce("_less", F.lit(0)))
            margins[m] = cut_lineage(left.drop("_less"))
    out = stored["n1_"].drop("_bucket")
    for m, keys in sides.items():
        out = out.join(margins[m].drop("_bucket"), keys)
    total = F.sum("n1_").alias("N")
    if by:
        return out.join(margins["n1_"].groupBy(*by).agg(total), by)
    return out.withColumn("N", margins["n1_"].agg(total).scalar())


def min_count(ct: DataFrame, k: int) -> DataFrame:
    """Keep cells with at least ``k`` reports, after the margins are formed."""
    return ct.filter(F.col("n11") >= k) if k > 1 else ct
