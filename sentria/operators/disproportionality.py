"""Frequentist disproportionality statistics over a contingency frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.functions.kernels import fisher_udf
from sentria.functions.special import Z_95, num, safe_div, safe_log
from sentria.operators.contingency import min_count
from sentria.session import spread_cells


def cells(ct: DataFrame) -> DataFrame:
    """Add the other three cells and the expected count as doubles."""
    n11, n1_, n_1, n = num("n11"), num("n1_"), num("n_1"), num("N")
    return ct.withColumns(
        {
            "n10": n1_ - n11,
            "n01": n_1 - n11,
            "n00": n - n1_ - n_1 + n11,
            "expected_count": n1_ * n_1 / n,
        }
    )


def _interval(t: DataFrame, name: str, ratio: Column, variance: Column) -> DataFrame:
    # Separate projections: each name below is computed once and referenced.
    log, var = f"log{name}", f"var_log{name}"
    t = t.withColumns({name: ratio, var: variance})
    t = t.withColumn(log, safe_log(F.col(name)))
    margin = F.lit(Z_95) * F.sqrt(F.col(var))
    t = t.withColumns({f"LB95_{log}": F.col(log) - margin, f"UB95_{log}": F.col(log) + margin})
    return t.withColumns(
        {f"LB95_{name}": F.exp(F.col(f"LB95_{log}")), f"UB95_{name}": F.exp(F.col(f"UB95_{log}"))}
    )


def _inverse(c: str) -> Column:
    return safe_div(F.lit(1.0), F.col(c))


def prr(ct: DataFrame) -> DataFrame:
    """Proportional reporting ratio with 95% bounds.

    It is infinite when no other drug has the event and NaN when there is no
    other drug; both are kept as values.
    """
    others = F.col("n01") + F.col("n00")
    ratio = safe_div(safe_div(num("n11"), num("n1_")), safe_div(F.col("n01"), others))
    variance = _inverse("n11") - _inverse("n1_") + _inverse("n01") - safe_div(F.lit(1.0), others)
    return _interval(ct, "PRR", ratio, variance)


def ror(ct: DataFrame) -> DataFrame:
    """Reporting odds ratio with 95% bounds."""
    ratio = safe_div(num("n11") * F.col("n00"), F.col("n10") * F.col("n01"))
    variance = _inverse("n11") + _inverse("n10") + _inverse("n01") + _inverse("n00")
    return _interval(ct, "ROR", ratio, variance)


def rrr(ct: DataFrame) -> DataFrame:
    """Relative reporting ratio (observed over expected) with 95% bounds."""
    ratio = safe_div(num("n11") * num("N"), num("n1_") * num("n_1"))
    variance = _inverse("n11") - _inverse("n1_") + _inverse("n_1") - _inverse("N")
    return _interval(ct, "RRR", ratio, variance)


def rfet(ct: DataFrame, or0: float = 1.0, min_n11: int = 1, repartition: bool = True) -> DataFrame:
    """One-sided exact test of an odds ratio above ``or0``: ``RFET`` and mid-p ``midRFET``.

    The tail of the (noncentral) hypergeometric distribution is summed until
    the rest is below double precision, in Arrow batches. Rows are spread over
    all cores first, because the test costs far more than its bytes suggest.
    """
    kept = min_count(ct, min_n11)
    if repartition:
        kept = spread_cells(kept, "drug_code", "event_effect")
    tested = kept.withColumn(
        "_exact", fisher_udf(float(or0))(F.col("n11"), F.col("n1_"), F.col("n_1"), F.col("N"))
    )
    return tested.withColumns({"RFET": F.col("_exact.p"), "midRFET": F.col("_exact.mid_p")}).drop("_exact")
