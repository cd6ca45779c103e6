"""Gamma-Poisson shrinkage: prior fit and posterior summaries (DuMouchel, 1999)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.functions.kernels import gamma_mixture_udf, negative_binomial_sums
from sentria.functions.special import digamma, lgamma, num, solid
from sentria.operators.contingency import min_count
from sentria.session import cut_lineage, spread_cells

# Margins are put into this many classes per unit of their natural logarithm.
_CLASSES_PER_UNIT = 64


@dataclass(frozen=True)
class GammaMixture:
    """Prior w * Gamma(alpha1, beta1) + (1 - w) * Gamma(alpha2, beta2), beta as rate.

    The defaults are the starting values suggested by DuMouchel (1999).
    """

    alpha1: float = 0.2
    beta1: float = 0.1
    alpha2: float = 2.0
    beta2: float = 4.0
    w: float = 1.0 / 3.0
    log_likelihood: float = float("nan")
    converged: bool = False

    def to_vector(self) -> np.ndarray:
        """Unconstrained parameters: logs of the four, logit of the weight."""
        logs = np.log([self.alpha1, self.beta1, self.alpha2, self.beta2])
        return np.append(logs, math.log(self.w / (1.0 - self.w)))

    def params(self) -> tuple[float, ...]:
        return (self.alpha1, self.beta1, self.alpha2, self.beta2, self.w)

    @classmethod
    def from_vector(
        cls, v: np.ndarray, log_likelihood: float = float("nan"), converged: bool = False
    ) -> GammaMixture:
        a1, b1, a2, b2 = (float(x) for x in np.exp(v[:4]))
        return cls(a1, b1, a2, b2, 1.0 / (1.0 + math.exp(-v[4])), log_likelihood, converged)


def _component(n: Column, e: Column, alpha: float, beta: float) -> Column:
    """Log probability of n under a negative binomial, without the n! both components share."""
    return (
        lgamma(f"(_n + {alpha!r}D)")
        - math.lgamma(alpha)
        + n * F.ln(e)
        - (n + alpha) * F.ln(e + beta)
        + alpha * math.log(beta)
    )


def _with_weights(t: DataFrame, prior: GammaMixture, n: Column, e: Column) -> DataFrame:
    """Add ``Q``, the posterior weight of the first component; the count is in ``_n``."""
    t = t.withColumns(
        {
            "_l1": _component(n, e, prior.alpha1, prior.beta1) + math.log(prior.w),
            "_l2": _component(n, e, prior.alpha2, prior.beta2) + math.log1p(-prior.w),
        }
    )
    t = t.withColumn("Q", F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_l2") - F.col("_l1"))))
    return t.drop("_l1", "_l2")


_SUMS = [f"s{i}" for i in range(6)]


def _observed_part(cells: DataFrame, candidates: list[tuple[float, ...]]) -> np.ndarray:
    """Log-likelihood and gradient of every candidate over the observed cells, in one scan.

    Each task adds up its own Arrow batches; six numbers per candidate and task
    reach the driver. (As Column literals the changing parameters would compile new
    code at every step of the search.)
    """

    def partial(batches):
        total = np.zeros((len(candidates), 6))
        for b in batches:
            rows = b["n"].to_numpy(), b["e"].to_numpy(), b["cells"].to_numpy()
            total += [negative_binomial_sums(*rows, params) for params in candidates]
        yield pd.DataFrame(total, columns=_SUMS).assign(k=range(len(candidates)))

    rows = cells.mapInPandas(partial, ", ".join([*(f"{s} double" for s in _SUMS), "k int"])).collect()
    out = np.zeros((len(candidates), 6))
    # Summed in one order, so that every evaluation gives the same digits.
    for r in sorted(rows):
        out[r.k] += r[:6]
    return out


def _margin_class(c: str) -> Column:
    return F.floor(F.ln(num(c)) * _CLASSES_PER_UNIT).cast("int")


def empty_cells(ct: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts and numbers of the empty (drug, event) cells, by class.

    All drug x event cells are counted without forming them: E depends only on
    a product of margins, so the cells per class of log E are the convolution of
    two histograms of log margins. The histograms have at most 64 classes per
    unit of the logarithm of a 64-bit count, below 2,900 rows whatever the data.
    """
    # The observed cells of each class, with their expected counts.
    seen = (
        ct.groupBy((_margin_class("n1_") + _margin_class("n_1")).alias("k"))
        .agg(F.count(F.lit(1)).alias("cells"), F.sum(num("n1_") * num("n_1")).alias("product"))
        .toPandas()
    )
    sides = []
    for key, margin in (("drug_code", "n1_"), ("event_effect", "n_1")):
        hist = (
            ct.select(key, margin)
            .distinct()
            .groupBy(_margin_class(margin).alias("k"))
            .agg(F.count(F.lit(1)).alias("terms"), F.sum(num(margin)).alias("total"))
            .toPandas()
        )
        terms, total = np.zeros(hist["k"].max() + 1), np.zeros(hist["k"].max() + 1)
        terms[hist["k"]] = hist["terms"]
        total[hist["k"]] = hist["total"]
        sides.append((terms, total))
    cells = np.convolve(sides[0][0], sides[1][0])
    product = np.convolve(sides[0][1], sides[1][1])
    cells[seen["k"]] -= seen["cells"]
    product[seen["k"]] -= seen["product"]
    n = float(ct.select(F.max("N")).head()[0])
    some = np.rint(cells) > 0
    return product[some] / cells[some] / n, np.rint(cells[some])


def gps_fit(
    ct: DataFrame,
    start: GammaMixture | None = None,
    include_empty: bool = True,
    max_steps: int = 200,
    tolerance: float = 1e-6,
) -> GammaMixture:
    """Maximum-likelihood prior from an overall contingency frame.

    Likelihood and gradient are sums over cells: each step is one scan of
    the observed cells for all its step lengths, plus the closed form over the classes of
    empty cells when ``include_empty`` (the full drug x event table). The
    driver holds five parameters and a 5 x 5 matrix. Cells with equal counts and
    margins are merged before the search, which starts from the fit of a table of
    classes that the driver holds, of bounded size (``_squashed``). ``converged`` of the result tells whether ``max_steps`` sufficed.
    """
    pairs = cut_lineage(ct.select("drug_code", "event_effect", "n11", "n1_", "n_1", "N"))
    # E is a function of the product of the margins: their order makes no difference.
    low, high = F.least("n1_", "n_1").alias("low"), F.greatest("n1_", "n_1").alias("high")
    merged = pairs.select("n11", low, high, "N").groupBy("n11", "low", "high", "N").agg(F.count(F.lit(1)).alias("cells"))
    e = num("low") * num("high") / num("N")
    cells = merged.select(num("n11").alias("n"), e.alias("e"), num("cells").alias("cells")).persist()
    empty = empty_cells(pairs) if include_empty else (np.zeros(0), np.zeros(0))
    size = float(cells.agg(F.sum("cells")).head()[0]) + float(empty[1].sum())

    def objective(points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        candidates = [GammaMixture.from_vector(v).params() for v in points]
        sums = _observed_part(cells, candidates)
        if len(empty[0]):
            sums = sums + [negative_binomial_sums(np.zeros(len(empty[0])), *empty, params) for params in candidates]
        return -sums[:, 0] / size, -sums[:, 1:] / size

    squashed = _squashed(cells)

    def rough(points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros((len(points), 6))
        for k, v in enumerate(points):
            params = GammaMixture.from_vector(v).params()
            sums[k] = negative_binomial_sums(*squashed, params)
            if len(empty[0]):
                sums[k] += negative_binomial_sums(np.zeros(len(empty[0])), *empty, params)
        return -sums[:, 0] / size, -sums[:, 1:] / size

    first = (start or GammaMixture()).to_vector()
    near, _, _, bend = _quasi_newton(rough, first, max_steps, tolerance, np.eye(len(first)))
    v, value, converged, _ = _quasi_newton(objective, near, max_steps, tolerance, bend)
    cells.unpersist()
    return GammaMixture.from_vector(v, -value * size, converged)


def gps_likelihood(ct: DataFrame, prior: GammaMixture) -> DataFrame:
    """One row: mean log-likelihood of the observed cells under a prior, and its gradient.

    The factor 1/n11! is left out. The gradient is by the logarithms of the rates and
    shapes and by the logit of the weight, as in the search of ``gps_fit``.
    """
    params = prior.params()

    def partial(batches):
        total, rows = np.zeros(6), 0
        for b in batches:
            total += negative_binomial_sums(b["n"].to_numpy(), b["e"].to_numpy(), np.ones(len(b)), params)
            rows += len(b)
        yield pd.DataFrame([[*total, rows]], columns=[*_SUMS, "cells"])

    cells = ct.select(num("n11").alias("n"), (num("n1_") * num("n_1") / num("N")).alias("e"))
    sums = cells.mapInPandas(partial, ", ".join(f"{s} double" for s in [*_SUMS, "cells"]))
    names = ("log_likelihood", "by_log_alpha1", "by_log_beta1", "by_log_alpha2", "by_log_beta2", "by_logit_w")
    return sums.agg(*[(F.sum(s) / F.sum("cells")).alias(n) for s, n in zip(_SUMS, names)])


def _squashed(cells: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, expected counts and numbers of cells by class of both: a small table to start the search from.

    Counts from 64 on and expected counts go by sixteenths of their natural logarithm,
    so there are fewer than 800 x 1,500 classes whatever the data.
    """
    n_class = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.ln("n") * 16) / 16.0 + 64)
    share = lambda c: (F.sum(F.col(c) * F.col("cells")) / F.sum("cells")).alias(c)
    classes = cells.groupBy(n_class.alias("_n"), F.floor(F.ln("e") * 16).alias("_e"))
    rows = classes.agg(share("n"), share("e"), F.sum("cells").alias("cells")).drop("_n", "_e").toPandas()
    rows = rows.sort_values(["n", "e"])
    return tuple(rows[c].to_numpy() for c in ("n", "e", "cells"))


#: Step lengths along a direction that one evaluation tries; further ones are shorter by the last of them.
_RATES = (1.0, 0.5, 0.25, 0.1)


def _quasi_newton(
    objective, x: np.ndarray, max_steps: int, tolerance: float, inverse: np.ndarray
) -> tuple[np.ndarray, float, bool, np.ndarray]:
    """BFGS with a line search; the objective never increases. Also whether it ended by itself, and the inverse curvature.

    ``objective`` takes several points at once and gives their values and gradients.
    """
    values, slopes = objective([x])
    f, g = values[0], slopes[0]
    for _ in range(max_steps):
        if np.max(np.abs(g)) < tolerance:
            break
        direction = -inverse @ g
        if direction @ g >= 0:
            inverse, direction = np.eye(len(x)), -g
        longest = np.max(np.abs(direction))
        scale = min(1.0, 2.0 / longest) if longest > 0 else 1.0
        good: list[int] = []
        while scale > 1e-10 and not good:
            rates = [scale * r for r in _RATES]
            points = [x + r * direction for r in rates]
            values, slopes = objective(points)
            enough = [f + 1e-4 * r * (g @ direction) for r in rates]
            good = [k for k, v in enumerate(values) if np.isfinite(v) and v <= enough[k]]
            scale *= _RATES[-1]
        if not good:
            break
        nxt, f2, g2 = points[good[0]], values[good[0]], slopes[good[0]]
        s, y = nxt - x, g2 - g
        gain = f - f2
        x, f, g = nxt, f2, g2
        if s @ y > 1e-14:
            rho = 1.0 / (s @ y)
            left = np.eye(len(x)) - rho * np.outer(s, y)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
        if gain < 1e-13 * max(1.0, abs(f)):
            break
    else:
        return x, f, False, inverse
    return x, f, True, inverse


def gps(
    ct: DataFrame,
    prior: GammaMixture,
    rr0: float = 1.0,
    min_n11: int = 1,
    level: float = 0.05,
    quantiles: bool = True,
) -> DataFrame:
    """Posterior of each pair's reporting rate under a fitted prior.

    Adds ``n11_over_E``, ``Q`` (posterior weight of the first component),
    ``postE_lambda`` (mean), ``postE_log2_lambda`` and, unless ``quantiles`` is
    off, ``postH0`` = P(lambda <= rr0) and ``Q0.05_lambda`` as ``Q05_lambda``.
    """
    t = min_count(ct, min_n11)
    if quantiles:
        t = spread_cells(t, "drug_code", "event_effect")
    t = t.withColumns({"_n": solid(num("n11")), "_e": solid(num("n1_") * num("n_1") / num("N"))})
    n, e = F.col("_n"), F.col("_e")
    t = _with_weights(t, prior, n, e)
    q = F.col("Q")
    mean1 = (n + prior.alpha1) / (e + prior.beta1)
    mean2 = (n + prior.alpha2) / (e + prior.beta2)
    log1 = digamma(f"(_n + {prior.alpha1!r}D)") - F.ln(e + prior.beta1)
    log2 = digamma(f"(_n + {prior.alpha2!r}D)") - F.ln(e + prior.beta2)
    t = t.withColumns(
        {
            "n11_over_E": n / e,
            "postE_lambda": q * mean1 + (F.lit(1.0) - q) * mean2,
            "postE_log2_lambda": (q * log1 + (F.lit(1.0) - q) * log2) / math.log(2.0),
        }
    )
    if quantiles:
        t = t.withColumn(
            "_tail",
            gamma_mixture_udf(level, rr0)(
                q, n + prior.alpha1, e + prior.beta1, n + prior.alpha2, e + prior.beta2
            ),
        )
        t = t.withColumns({"postH0": F.col("_tail.post_h0"), "Q05_lambda": F.col("_tail.quantile")})
    return t.drop("_n", "_e", "_tail")
