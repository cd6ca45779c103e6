"""NumPy kernels for the few statistics Spark SQL cannot express.

Each works on one Arrow batch of independent cells; Spark partitions the rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

# Executors get the code of this module with each task, so the package need not
# be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
# Stirling error of small integers: log k! minus Stirling's approximation.
_SMALL = np.array(
    [0.0]
    + [math.lgamma(k + 1.0) - (k + 0.5) * math.log(k) + k - _HALF_LOG_2PI for k in range(1, 16)]
)


def _stirling_series(n: np.ndarray) -> np.ndarray:
    r = 1.0 / n
    s = r * r
    return r * (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s * (1 / 1188 - s * (691 / 360360 - s / 156))))))


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log n! - ((n + 1/2) log n - n + log(2 pi)/2) for whole n >= 0."""
    small = n < 16
    return np.where(small, _SMALL[np.where(small, n, 0).astype(int)], _stirling_series(np.maximum(n, 16.0)))


def _deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x log(x/m) + m - x without cancellation when x is near m (Loader, 2000)."""
    d = x - m
    v = d / (x + m)
    near = np.abs(v) < 0.1
    v2 = v * v
    term = 2.0 * x * v
    series = d * v
    for k in range(1, 14):
        term = term * v2
        series = series + term / (2 * k + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        direct = x * np.log(x / m) + m - x
    return np.where(near, series, direct)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = 1.0 - p
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = (
            _stirling_error(n)
            - _stirling_error(x)
            - _stirling_error(n - x)
            - _deviance(x, n * p)
            - _deviance(n - x, n * q)
            + 0.5 * (np.log(n) - np.log(x) - np.log(n - x))
            - _HALF_LOG_2PI
        )
        none = np.where(n > 0, n * np.log1p(-p), 0.0)
        full = np.where(n > 0, n * np.log(p), 0.0)
    return np.where(x == 0, none, np.where(x == n, full, middle))


def log_hypergeometric(x, drawn, marked, total) -> np.ndarray:
    """Log probability of x marked items among ``drawn`` from ``total``, by saddle point."""
    p = drawn / total
    return (
        _log_binomial(x, marked, p)
        + _log_binomial(drawn - x, total - marked, p)
        - _log_binomial(drawn, total, p)
    )


def _ratio_sum(x, drawn, marked, total, psi, up: bool) -> np.ndarray:
    """Sum of w(y)/w(x) over y beyond x, for x on the side where weights fall.

    The weights are log-concave: the ratio only shrinks, so the rest after any
    term is below a geometric series, which gives an exact stopping rule.
    """
    out = np.zeros(len(x))
    rows = np.arange(len(x))
    y, d, m, n = x.copy(), drawn, marked, total
    term = np.ones(len(x))
    while len(rows):
        if up:
            ratio = psi * (m - y) * (d - y) / ((y + 1.0) * (n - m - d + y + 1.0))
        else:
            ratio = y * (n - m - d + y) / (psi * (m - y + 1.0) * (d - y + 1.0))
        ratio = np.maximum(ratio, 0.0)
        term = term * ratio
        out[rows] += term
        y = y + (1.0 if up else -1.0)
        live = term > 1e-17 * (1.0 + out[rows]) * np.maximum(1.0 - ratio, 1e-12)
        if not live.all():
            rows, y, d, m, n, term = rows[live], y[live], d[live], m[live], n[live], term[live]
    return out


def _mode(drawn, marked, total, psi: float) -> np.ndarray:
    """Mode of Fisher's noncentral hypergeometric distribution (Liao and Rosen, 2001)."""
    a = psi - 1.0
    b = -((marked + drawn + 2.0) * psi + total - marked - drawn)
    c = (marked + 1.0) * (drawn + 1.0) * psi
    q = -(b - np.sqrt(np.maximum(b * b - 4.0 * a * c, 0.0))) / 2.0
    low = np.maximum(0.0, drawn + marked - total)
    return np.clip(np.floor(c / q), low, np.minimum(drawn, marked))


def fisher_greater(n11, n1_, n_1, total, or0: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """P(X >= n11) and mid-p of the exact test with odds ratio ``or0`` under the null."""
    x, d, m, n = (np.asarray(v, dtype=float) for v in (n11, n1_, n_1, total))
    mode = _mode(d, m, n, or0)
    log_w = log_hypergeometric(x, d, m, n)
    if or0 != 1.0:
        log_w = log_w + x * math.log(or0)
        around = 1.0 + _ratio_sum(mode, d, m, n, or0, True) + _ratio_sum(mode, d, m, n, or0, False)
        log_w -= log_hypergeometric(mode, d, m, n) + mode * math.log(or0) + np.log(around)
    point = np.exp(log_w)
    upper = x > mode
    p = np.empty(len(x))
    u = upper
    p[u] = point[u] * (1.0 + _ratio_sum(x[u], d[u], m[u], n[u], or0, True))
    # At or below the mode the tail is 1 minus the sum below n11: no cancellation
    # trouble, because p is not small there.
    lo = ~upper
    p[lo] = 1.0 - point[lo] * _ratio_sum(x[lo], d[lo], m[lo], n[lo], or0, False)
    return np.clip(p, 0.0, 1.0), np.clip(p - 0.5 * point, 0.0, 1.0)


def once_per_cell(kernel: Callable, *columns: pd.Series) -> dict[str, np.ndarray]:
    """Results of a kernel that is run once for each stretch of equal rows.

    The caller sorts rows by their cells, so a cell that many pairs share is
    evaluated once in a batch.
    """
    values = [c.to_numpy() for c in columns]
    new = np.ones(len(values[0]), bool)
    new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
    found = kernel(*(v[new] for v in values))
    place = np.cumsum(new) - 1
    return {name: v[place] for name, v in found.items()}


def fisher_udf(or0: float) -> Callable:
    def kernel(*cells):
        return dict(zip(("p", "mid_p"), fisher_greater(*cells, or0)))

    @F.pandas_udf("p double, mid_p double")
    def exact(n11: pd.Series, n1_: pd.Series, n_1: pd.Series, total: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(once_per_cell(kernel, n11, n1_, n_1, total))

    return exact


def dirichlet_ic(n11, n10, n01, n00, total, seeds, draws: int, log_rr0: float) -> dict[str, np.ndarray]:
    """Sampled posterior of log(p11 / (p1_ p_1)) under an independence prior.

    Each cell has its own seed, so the result depends on neither the batch nor
    the partition. A Dirichlet draw is four gamma draws over their sum; the sum
    cancels down to one factor, and since log is monotone only the three order
    statistics are logged.
    """
    half = np.asarray(total, float) + 1.0
    q1 = (n11 + n10 + 0.5) / half
    q_1 = (n11 + n01 + 0.5) / half
    q0 = (n01 + n00 + 0.5) / half
    q_0 = (n10 + n00 + 0.5) / half
    shapes = np.stack(
        [
            n11 + 0.5,
            n10 + 0.5 * q_0 / q_1,
            n01 + 0.5 * q0 / q1,
            n00 + 0.5 * q0 * q_0 / (q1 * q_1),
        ],
        axis=1,
    )
    at = [max(int(np.rint(draws * share)) - 1, 0) for share in (0.025, 0.5, 0.975)]
    rr0 = math.exp(log_rr0)
    out = np.empty((len(shapes), 4))
    for i, (shape, seed) in enumerate(zip(shapes, seeds)):
        rng = np.random.Generator(np.random.SFC64(int(seed) & 0xFFFFFFFFFFFFFFFF))
        g11, g10, g01, rest = (rng.standard_gamma(k, draws) for k in shape)
        row, column = g11 + g10, g11 + g01
        rest += row
        rest += g01
        rest *= g11
        rest /= row
        rest /= column
        rest.sort()
        out[i, :3] = rest[at]
        out[i, 3] = np.searchsorted(rest, rr0, side="left") / draws
    logs = np.log(out[:, :3])
    return {"lower": logs[:, 0], "median": logs[:, 1], "upper": logs[:, 2], "post_h0": out[:, 3]}


def dirichlet_udf(draws: int, log_rr0: float) -> Callable:
    def kernel(n11, n10, n01, n00, total, seeds):
        cells = (v.astype(float) for v in (n11, n10, n01, n00, total))
        return dirichlet_ic(*cells, seeds, draws, log_rr0)

    @F.pandas_udf("lower double, median double, upper double, post_h0 double")
    def sample(
        n11: pd.Series, n10: pd.Series, n01: pd.Series, n00: pd.Series, total: pd.Series, seed: pd.Series
    ) -> pd.DataFrame:
        return pd.DataFrame(once_per_cell(kernel, n11, n10, n01, n00, total, seed))

    return sample


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0."""
    x = np.asarray(x, dtype=float)
    small = x < 16.0
    y = np.where(small, x + 16.0, x)
    rising = np.ones_like(x)
    base = np.where(small, x, 1.0)
    for k in range(16):
        rising = rising * np.where(small, base + k, 1.0)
    return (y - 0.5) * np.log(y) - y + _HALF_LOG_2PI + _stirling_series(y) - np.log(rising)


def di_gamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log Gamma for x > 0."""
    x = np.asarray(x, dtype=float)
    small = x < 16.0
    y = np.where(small, x + 16.0, x)
    below = np.zeros_like(x)
    base = np.where(small, x, 1.0)
    for k in range(16):
        below = below + np.where(small, 1.0 / (base + k), 0.0)
    s = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s / 240))) - below


def negative_binomial_sums(n, e, cells, params) -> np.ndarray:
    """Log-likelihood of a two-component negative binomial mixture and its gradient.

    ``params`` are alpha1, beta1, alpha2, beta2 and the weight of the first
    component; the gradient is by the logs of the first four and the logit of
    the weight. The factor 1/n! both components share is left out.
    """
    a1, b1, a2, b2, w = params
    logs, slopes = [], []
    for alpha, beta in ((a1, b1), (a2, b2)):
        shifted, scale = n + alpha, np.log(e + beta)
        log_e = np.where(n > 0, n * np.log(e), 0.0)
        logs.append(
            log_gamma(shifted) - math.lgamma(alpha) + log_e - shifted * scale + alpha * math.log(beta)
        )
        by_alpha = di_gamma(shifted) - di_gamma(np.array([alpha]))[0] + math.log(beta) - scale
        slopes.append((alpha * by_alpha, alpha - beta * shifted / (e + beta)))
    l1, l2 = logs[0] + math.log(w), logs[1] + math.log1p(-w)
    q = 1.0 / (1.0 + np.exp(np.clip(l2 - l1, -700.0, 700.0)))
    parts = [np.logaddexp(l1, l2), q * slopes[0][0], q * slopes[0][1],
             (1.0 - q) * slopes[1][0], (1.0 - q) * slopes[1][1], q - w]
    return np.array([np.dot(cells, p) for p in parts])


# From this shape on the incomplete gamma function is integrated numerically.
_LARGE_SHAPE = 100.0
_NODES, _NODE_WEIGHTS = np.polynomial.legendre.leggauss(48)


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x)."""
    a, x = (np.ascontiguousarray(v) for v in np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float)))
    out = np.zeros(a.shape)
    big = (x > 0) & (a >= _LARGE_SHAPE)
    series = (x > 0) & ~big & (x < a + 1.0)
    fraction = (x > 0) & ~big & ~series
    for some, rule in ((big, _by_quadrature), (series, _by_series), (fraction, _by_fraction)):
        if some.any():
            out[some] = rule(a[some], x[some])
    return np.clip(out, 0.0, 1.0)


def _by_quadrature(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Gauss-Legendre over the tail on the far side of x, where the density only falls.

    The density around its mode a - 1 is exp(-deviance) over a Stirling factor,
    so nothing cancels however large the shape; the tail beyond the interval is
    below double precision.
    """
    m = a - 1.0
    width = np.sqrt(m)
    upper = x > m
    end = np.where(
        upper, np.maximum(m + 12.0 * width, x + 7.0 * width), np.maximum(0.0, np.minimum(m - 9.0 * width, x - 6.0 * width))
    )
    total = np.zeros(len(a))
    for node, weight in zip(_NODES, _NODE_WEIGHTS):
        t = x + (end - x) * (0.5 * (node + 1.0))
        total += weight * np.exp(-_deviance(m, np.maximum(t, 1e-300)))
    tail = 0.5 * np.abs(end - x) * total * np.exp(-_HALF_LOG_2PI - 0.5 * np.log(m) - _stirling_series(m))
    return np.where(upper, 1.0 - tail, tail)


def _lead(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.exp(a * np.log(x) - x - log_gamma(a))


def _by_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    lead = _lead(a, x)
    rows = np.arange(len(a))
    term = 1.0 / a
    total = term.copy()
    while len(rows):
        a = a + 1.0
        term = term * x / a
        total[rows] += term
        live = term > 1e-17 * total[rows] * np.maximum(1.0 - x / (a + 1.0), 1e-12)
        rows, a, x, term = rows[live], a[live], x[live], term[live]
    return total * lead


def _by_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1.0 - _lead(a, x) * _upper_fraction(a, x)


def _upper_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the upper incomplete gamma function (modified Lentz)."""
    tiny = 1e-300
    result = np.empty(len(a))
    rows = np.arange(len(a))
    b = x + 1.0 - a
    c = np.full(len(a), 1.0 / tiny)
    d = 1.0 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    k = 0
    while len(rows):
        k += 1
        an = -k * (k - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = c * d
        h = h * step
        result[rows] = h
        live = np.abs(step - 1.0) > 1e-15
        if k > 100_000:
            raise ArithmeticError("incomplete gamma fraction did not converge")
        rows, a, b, c, d, h = rows[live], a[live], b[live], c[live], d[live], h[live]
    return result


def mixture_cdf(x, q, a1, r1, a2, r2) -> np.ndarray:
    """P(lambda <= x) of a two-component gamma mixture."""
    return q * gamma_cdf(a1, r1 * x) + (1.0 - q) * gamma_cdf(a2, r2 * x)


def mixture_quantile(level: float, q, a1, r1, a2, r2) -> np.ndarray:
    """Quantile of the mixture by Newton steps kept inside a shrinking bracket."""
    lo = np.zeros(len(q))
    hi = np.maximum(a1 / r1, a2 / r2) + 1e-300
    short = mixture_cdf(hi, q, a1, r1, a2, r2) < level
    while short.any():
        hi = np.where(short, hi * 2.0, hi)
        short = mixture_cdf(hi, q, a1, r1, a2, r2) < level
    x = 0.5 * hi
    k1 = a1 * np.log(r1) - log_gamma(a1)
    k2 = a2 * np.log(r2) - log_gamma(a2)
    out = np.empty(len(q))
    left = np.arange(len(q))
    for _ in range(200):
        if not len(left):
            return out
        f = mixture_cdf(x, q, a1, r1, a2, r2) - level
        lo = np.where(f < 0, x, lo)
        hi = np.where(f < 0, hi, x)
        log_x = np.log(x)
        density = q * np.exp(k1 + (a1 - 1) * log_x - r1 * x) + (1 - q) * np.exp(k2 + (a2 - 1) * log_x - r2 * x)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = x - f / density
        inside = (step > lo) & (step < hi)
        nxt = np.where(inside, step, 0.5 * (lo + hi))
        done = np.abs(nxt - x) <= 1e-13 * x
        out[left[done]] = nxt[done]
        x, lo, hi, q, a1, r1, a2, r2, k1, k2, left = (
            v[~done] for v in (nxt, lo, hi, q, a1, r1, a2, r2, k1, k2, left)
        )
    if len(left):
        raise RuntimeError("a quantile of the mixture has not converged")
    return out


def gamma_mixture_udf(level: float, rr0: float) -> Callable:
    def kernel(*columns):
        args = [v.astype(float) for v in columns]
        return {"post_h0": mixture_cdf(rr0, *args), "quantile": mixture_quantile(level, *args)}

    @F.pandas_udf("post_h0 double, quantile double")
    def posterior(
        q: pd.Series, a1: pd.Series, r1: pd.Series, a2: pd.Series, r2: pd.Series
    ) -> pd.DataFrame:
        return pd.DataFrame(once_per_cell(kernel, q, a1, r1, a2, r2))

    return posterior
