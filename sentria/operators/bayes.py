"""Information components: closed form and sampled."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.functions.kernels import dirichlet_udf
from sentria.functions.special import Z_95, digamma, norm_cdf, num, raised_inverse, solid, trigamma
from sentria.operators.contingency import min_count
from sentria.session import spread


def bcpnn(ct: DataFrame, rr0: float = 1.0, min_n11: int = 1, log_base: float = 2.0) -> DataFrame:
    """Closed-form information component from beta posteriors.

    Adds ``IC`` (posterior mean), ``var_IC``, ``LB95_IC``, ``UB95_IC`` and
    ``postH0``, the posterior probability that the component is below
    ``log(rr0)``. The component is in units of ``log_base``; the threshold stays
    the natural logarithm of ``rr0``.
    """
    t = min_count(ct, min_n11)
    n11, n1_, n_1, n = (solid(num(c)) for c in ("n11", "n1_", "n_1", "N"))
    t = t.withColumns({"_r1": n11 + 1.0, "_p1": n1_ + 1.0, "_q1": n_1 + 1.0, "_n2": n + 2.0})
    t = t.withColumn(
        "_rn", solid(n + F.col("_n2") * F.col("_n2") / (F.col("_q1") * F.col("_p1")))
    )
    arguments = ("_r1", "_p1", "_q1", "_n2", "_rn")
    t = t.withColumns({f"{a}i": raised_inverse(a) for a in arguments})
    psi = {a: digamma(a, f"{a}i") for a in arguments}
    psi1 = {a: trigamma(a, f"{a}i") for a in arguments}
    unit = 1.0 / math.log(log_base)
    mean = (psi["_r1"] - psi["_rn"] - psi["_p1"] - psi["_q1"] + psi["_n2"] * 2.0) * unit
    variance = (psi1["_r1"] - psi1["_rn"] + psi1["_p1"] + psi1["_q1"] - psi1["_n2"] * 2.0) * (unit * unit)
    t = t.withColumns({"IC": mean, "var_IC": variance})
    t = t.withColumn("_sd", F.sqrt("var_IC"))
    t = t.withColumns(
        {
            "LB95_IC": F.col("IC") - F.col("_sd") * Z_95,
            "UB95_IC": F.col("IC") + F.col("_sd") * Z_95,
            "_z": solid((F.lit(math.log(rr0)) - F.col("IC")) / F.col("_sd")),
        }
    )
    helpers = [*arguments, *[f"{a}i" for a in arguments], "_sd", "_z"]
    return t.withColumn("postH0", norm_cdf("_z")).drop(*helpers)


def bcpnn_mc(
    ct: DataFrame,
    draws: int = 10_000,
    seed: int = 0,
    rr0: float = 1.0,
    min_n11: int = 1,
) -> DataFrame:
    """Sampled information component (natural logarithm) of a Dirichlet posterior.

    Adds ``median_IC, LB95_IC, UB95_IC, postH0``. Every cell draws from its own
    generator, seeded by a hash of its counts, so the same seed gives the same
    rows under any partitioning and after any task retry. Pairs with equal counts
    have equal results: each distinct cell is drawn once and joined to its pairs.
    """
    t = min_count(ct, min_n11)
    names = ["n11", "n1_", "n_1", "N"]
    cells = spread(t.select(*names).distinct(), *names)
    n11, n1_, n_1, n = (F.col(c).cast("double") for c in names)
    key = F.xxhash64(F.lit(seed), *[F.col(c).cast("long") for c in names])
    sampled = cells.withColumn(
        "_ic",
        dirichlet_udf(draws, math.log(rr0))(n11, n1_ - n11, n_1 - n11, n - n1_ - n_1 + n11, n, key),
    )
    return t.join(sampled, names).select(*t.columns, "_ic").withColumns(
        {
            "median_IC": F.col("_ic.median"),
            "LB95_IC": F.col("_ic.lower"),
            "UB95_IC": F.col("_ic.upper"),
            "postH0": F.col("_ic.post_h0"),
        }
    ).drop("_ic")
