"""Error rates along a ranking of pairs, without a single-task global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.functions.special import safe_div
from sentria.session import cut_lineage


def _sort_keys(rank_by: str, descending: bool) -> list[Column]:
    lead = F.col(rank_by).desc_nulls_last() if descending else F.col(rank_by).asc_nulls_last()
    return [lead, F.col("drug_code").asc(), F.col("event_effect").asc()]


def error_rates(stats: DataFrame, rank_by: str = "postH0", post_h0: str = "postH0", descending: bool | None = None) -> DataFrame:
    """Add ``rank, FDR, FNR, Se, Sp`` along a ranking.

    ``rank_by`` is ``postH0`` (ascending) or a lower bound (descending). With p
    the posterior null probability of the i-th of m pairs: FDR = mean of p up to
    i, FNR = sum of (1 - p) from i on over (m - i), Se = sum of (1 - p) up to i
    over its total, Sp = sum of p from i on over its total.

    Rows are range-partitioned by the whole sort key, so ties spread too. The
    partition number is pinned by a checkpoint; running sums are formed inside
    each partition and shifted by the totals of the partitions before it (one
    small row per partition).
    """
    if descending is None:
        descending = rank_by != post_h0
    keys = _sort_keys(rank_by, descending)
    tasks = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range step samples its input first; kept rows spare a second evaluation.
    kept = stats.persist()
    placed = cut_lineage(
        kept.repartitionByRange(tasks, *keys).withColumns(
            {"_part": F.spark_partition_id(), "_p": F.col(post_h0).cast("double")}
        )
    )
    kept.unpersist()
    per_part = placed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_p").alias("_sum_p")
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    offsets = per_part.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_sum_p").over(before), F.lit(0.0)).alias("_p_before"),
        F.sum("_rows").over(whole).alias("_m"),
        F.sum("_sum_p").over(whole).alias("_p_total"),
    )
    local = W.partitionBy("_part").orderBy(*keys)
    running = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (
        placed.withColumns({"_i": F.row_number().over(local), "_run": F.sum("_p").over(running)})
        .join(F.broadcast(offsets), "_part")
        .withColumns(
            {
                "rank": (F.col("_i") + F.col("_rows_before")).cast("long"),
                "_cum": F.col("_run") + F.col("_p_before"),
            }
        )
    )
    i, m, cum, p, total = (F.col(c) for c in ("rank", "_m", "_cum", "_p", "_p_total"))
    p_from = total - cum + p
    null_total = m - total
    good_from = (m - i + 1) - p_from
    return ranked.withColumns(
        {
            "FDR": cum / i,
            "FNR": safe_div(good_from, m - i),
            "Se": safe_div(i - cum, null_total),
            "Sp": safe_div(p_from, total),
        }
    ).drop("_part", "_p", "_i", "_run", "_rows_before", "_p_before", "_m", "_p_total", "_cum")
