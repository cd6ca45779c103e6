"""Special functions and kernels against exact values."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentria.functions import kernels as k
from sentria.functions import special as s

INF, NAN = float("inf"), float("nan")


def same(a, b):
    return (a is None and b is None) or a == b or (math.isnan(a) and math.isnan(b))


def test_safe_div_and_log_follow_ieee(spark):
    rows = [(1.0, 0.0, INF), (-1.0, 0.0, -INF), (0.0, 0.0, NAN), (NAN, 0.0, NAN), (6.0, 3.0, 2.0), (1.0, INF, 0.0)]
    t = spark.createDataFrame([*rows, (None, 0.0, None), (1.0, None, None)], "a double, b double, e double")
    for r in t.select("e", s.safe_div(F.col("a"), F.col("b")).alias("q")).collect():
        assert same(r.q, r.e)
    logs = spark.createDataFrame([(0.0, -INF), (1.0, 0.0), (INF, INF), (-1.0, NAN), (None, None)], "x double, e double")
    for r in logs.select("e", s.safe_log(F.col("x")).alias("q")).collect():
        assert same(r.q, r.e)


def test_gamma_family(spark):
    xs = [0.05, 0.5, 1.0, 2.0, 3.7, 40.0, 1234.5, 2.5e6]
    t = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = t.select("x", s.lgamma("x").alias("l"), s.digamma("x").alias("d"), s.trigamma("x").alias("t")).collect()
    for r in rows:
        assert math.isclose(r.l, math.lgamma(r.x), rel_tol=1e-12, abs_tol=1e-12)
        h = 1e-4 * max(r.x, 0.05)
        assert math.isclose(r.d, (math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h), rel_tol=1e-3, abs_tol=1e-6)
        assert math.isclose(k.di_gamma(np.array([r.x]))[0], r.d, rel_tol=1e-12)
    one = [r for r in rows if r.x == 1.0][0]
    assert math.isclose(one.d, -0.5772156649015329, rel_tol=1e-12)
    assert math.isclose(one.t, math.pi**2 / 6, rel_tol=1e-12)


def test_normal_distribution(spark):
    zs = [-38.0, -12.0, -5.7, -5.6, -1.0, -0.3, 0.0, 0.6, 0.7, 4.0, 9.0]
    t = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in t.select("z", s.norm_cdf("z").alias("p")).collect():
        assert math.isclose(r.p, 0.5 * math.erfc(-r.z / math.sqrt(2)), rel_tol=1e-12)


def exact_tail(x, drawn, marked, total, psi=Fraction(1)):
    lo, hi = max(0, drawn + marked - total), min(drawn, marked)
    w = {j: math.comb(marked, j) * math.comb(total - marked, drawn - j) * psi ** (j - lo) for j in range(lo, hi + 1)}
    whole = sum(w.values())
    p = sum(v for j, v in w.items() if j >= x)
    return float(Fraction(p) / whole), float((Fraction(p) - Fraction(w[x]) / 2) / whole)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_exact_test_against_rational_arithmetic(data):
    total = data.draw(st.integers(2, 600))
    marked = data.draw(st.integers(1, total))
    drawn = data.draw(st.integers(1, total))
    x = data.draw(st.integers(max(0, drawn + marked - total), min(drawn, marked)))
    psi = data.draw(st.sampled_from([1, 2, 5, 0.5]))
    p, mid = k.fisher_greater([x], [drawn], [marked], [total], float(psi))
    ep, em = exact_tail(x, drawn, marked, total, Fraction(psi))
    assert math.isclose(p[0], ep, rel_tol=1e-10, abs_tol=1e-290)
    assert math.isclose(mid[0], em, rel_tol=1e-9, abs_tol=1e-12)


def test_exact_test_far_below_expectation_does_not_underflow():
    p, mid = k.fisher_greater([1, 500_500], [10**6] * 2, [10**6] * 2, [2 * 10**6] * 2)
    assert p[0] == 1.0 and mid[0] == 1.0
    assert 0.07 < mid[1] < p[1] < 0.08


@pytest.mark.parametrize("a,x", [(1, 0.5), (3, 2.0), (50, 70.0), (99, 99.0), (101, 100.0), (150, 90.0), (1000, 950.0)])
def test_incomplete_gamma_of_whole_shapes(a, x):
    upper = math.fsum(math.exp(-x + j * math.log(x) - math.lgamma(j + 1)) for j in range(a))
    assert math.isclose(k.gamma_cdf(np.array([float(a)]), np.array([x]))[0], 1 - upper, rel_tol=1e-8, abs_tol=1e-12)


def test_mixture_quantile_inverts_the_distribution():
    q = np.array([0.2, 0.9, 0.5])
    args = (q, np.array([3.0, 12.0, 700_000.0]), np.array([2.0, 5.0, 700_000.0]), np.full(3, 41.0), np.full(3, 44.0))
    x = k.mixture_quantile(0.05, *args)
    assert np.allclose(k.mixture_cdf(x, *args), 0.05, atol=1e-10)


@pytest.mark.parametrize("x", [1.0, 15.999, 16.0, 3e13, 1e18])
def test_special_functions_at_any_size(spark, x):
    """Against series whose rest is below double precision for arguments of 50 or more."""
    big, steps = x, []
    while big < 50:
        steps.append(big)
        big += 1
    r = 1 / big
    psi = math.log(big) - r / 2 - r**2 / 12 + r**4 / 120 - r**6 / 252 - sum(1 / v for v in steps)
    psi1 = r + r**2 / 2 + r**3 / 6 - r**5 / 30 + r**7 / 42 + sum(1 / v**2 for v in steps)
    row = spark.createDataFrame([(x,)], "x double").select(
        s.digamma("x").alias("d"), s.trigamma("x").alias("t"), s.lgamma("x").alias("g")
    ).first()
    assert row.d == pytest.approx(psi, rel=1e-13, abs=1e-13)
    assert row.t == pytest.approx(psi1, rel=1e-12)
    assert row.g == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13)
