"""Statistics on hand-made tables, invariances and estimators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentria.operators import bayes, ranking, shrinkage
from sentria.operators import disproportionality as disp
from sentria.operators.contingency import contingency, min_count
from sentria.operators.counts import pair_counts, pair_counts_from_tables
from sentria.operators.search import filter_signals
from sentria.plans import signals as plans

BASIC = [("A", "x", 4), ("A", "y", 1), ("B", "x", 2), ("B", "z", 3)]


def ct_of(spark, rows, **kw):
    return contingency(spark.createDataFrame(rows, "d string, e string, count long"), "d", "e", **kw)


def by_pair(t):
    return {(r.drug_code, r.event_effect): r for r in t.collect()}


def test_margins_and_ratios_by_hand(spark):
    r = by_pair(disp.rrr(disp.ror(disp.prr(disp.cells(ct_of(spark, BASIC))))))
    ax = r["A", "x"]
    assert (ax.n11, ax.n1_, ax.n_1, ax.N) == (4, 5, 6, 10)
    assert (ax.n10, ax.n01, ax.n00, ax.expected_count) == (1, 2, 3, 3.0)
    assert math.isclose(ax.PRR, (4 / 5) / (2 / 5))
    assert math.isclose(ax.ROR, 4 * 3 / (1 * 2))
    assert math.isclose(ax.RRR, 4 * 10 / (5 * 6))
    assert math.isclose(ax.var_logPRR, 1 / 4 - 1 / 5 + 1 / 2 - 1 / 5)
    assert math.isclose(ax.LB95_PRR, math.exp(ax.logPRR - 1.959963984540054 * math.sqrt(ax.var_logPRR)))


def test_event_of_one_drug_is_infinite_with_nan_lower_bound(spark):
    for pair in (("B", "z"), ("A", "y")):
        r = by_pair(disp.prr(disp.cells(ct_of(spark, BASIC))))[pair]
        assert r.PRR == math.inf and r.UB95_PRR == math.inf and math.isnan(r.LB95_PRR)


def test_single_drug_is_nan(spark):
    for r in disp.prr(disp.cells(ct_of(spark, [("A", "x", 4), ("A", "y", 1)]))).collect():
        assert math.isnan(r.PRR)


def test_null_keys_vanish_before_totals(spark):
    r = by_pair(ct_of(spark, [(None, "x", 3), ("A", None, 1), ("A", "x", 2)]))
    assert list(r) == [("A", "x")] and (r["A", "x"].n_1, r["A", "x"].N) == (2, 2)


def fix_point(rows, k):
    rows = list(rows)
    while True:
        d, e = {}, {}
        for a, b, n in rows:
            d[a], e[b] = d.get(a, 0) + n, e.get(b, 0) + n
        kept = [(a, b, n) for a, b, n in rows if d[a] >= k and e[b] >= k]
        if kept == rows:
            return {(a, b): (n, d[a], e[b]) for a, b, n in rows}
        rows = kept


def test_margin_threshold_reaches_the_fix_point(spark):
    rows = [("A", "x", 9), ("A", "y", 1), ("B", "y", 2), ("B", "z", 1), ("C", "z", 2), ("C", "w", 1), ("D", "w", 5), ("D", "x", 4)]
    for k in (2, 3, 4, 6):
        got = {p: (r.n11, r.n1_, r.n_1) for p, r in by_pair(ct_of(spark, rows, min_margin=k)).items()}
        assert got == fix_point(rows, k), k


def test_peeling_of_groups_and_chains(spark):
    rng = random.Random(11)
    groups = {
        1: [(f"d{rng.randrange(25)}", f"e{rng.randrange(25)}", rng.randrange(1, 4)) for _ in range(60)],
        # Each removal makes the next key too small.
        2: [(f"d{k}", f"e{k}", 1) for k in range(5)] + [(f"d{k + 1}", f"e{k}", 1) for k in range(5)],
        3: [("d", "e", 9)],
    }
    for g in groups:
        groups[g] = [(a, b, n) for (a, b), n in {(a, b): n for a, b, n in groups[g]}.items()]
    rows = [(g, *r) for g, some in groups.items() for r in some]
    t = spark.createDataFrame(rows, "g int, D string, E string, count long")
    for k in (2, 6):
        out = contingency(t, "D", "E", by=["g"], min_margin=k).collect()
        for g, some in groups.items():
            kept = fix_point(some, k)
            assert {(r.drug_code, r.event_effect): (r.n11, r.n1_, r.n_1) for r in out if r.g == g} == kept
            assert {r.N for r in out if r.g == g} == ({sum(n for n, _, _ in kept.values())} if kept else set())
    assert contingency(t.limit(0), "D", "E", min_margin=3).count() == 0


def test_filters_come_after_margins(spark):
    whole = plans.standardise(disp.prr(disp.cells(ct_of(spark, BASIC))))
    kept = by_pair(filter_signals(whole, drugs=["A"], min_count=-3, min_exp=None))
    assert set(kept) == {("A", "x"), ("A", "y")}
    assert kept["A", "x"].PRR == by_pair(whole)["A", "x"].PRR
    assert set(by_pair(filter_signals(whole, drop_inf=True))) == {("A", "x"), ("B", "x")}
    assert set(by_pair(min_count(ct_of(spark, BASIC), 3))) == {("A", "x"), ("B", "z")}


def test_repeated_rows_and_a_hot_report_count_once(spark):
    drugs = spark.createDataFrame([(1, "A")] * 500 + [(1, "B"), (2, "A"), (3, None)], "REPORT_ID long, D string")
    rxn = spark.createDataFrame([(1, "x")] * 300 + [(1, "y"), (2, "x"), (3, "x")], "REPORT_ID long, E string")
    got = {(r.D, r.E): r["count"] for r in pair_counts_from_tables(drugs, rxn, "D", "E").collect()}
    assert got == {("A", "x"): 2, ("A", "y"): 1, ("B", "x"): 1, ("B", "y"): 1}


def sample(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{i}", f"e{j}", int(n)) for i in range(12) for j in range(9) if (n := rng.poisson(6 + 30 * (i == j))) > 0]
    return ct_of(spark, rows)


def test_sampling_is_centred_on_the_closed_form(spark):
    # The closed form takes the three proportions as independent, so only the
    # location is comparable.
    t = disp.cells(sample(spark))
    closed = by_pair(bayes.bcpnn(t, log_base=math.e))
    for p, r in by_pair(bayes.bcpnn_mc(t, draws=4000, seed=1)).items():
        if r.n11 >= 5:
            assert abs(r.median_IC - closed[p].IC) < 0.35 * math.sqrt(closed[p].var_IC) + 0.02


def test_sampling_matches_direct_dirichlet_draws(spark):
    rng = np.random.default_rng(9)
    drawn = bayes.bcpnn_mc(disp.cells(sample(spark)), draws=20_000, seed=1).collect()
    for r in drawn[::20]:
        share = [(x + 0.5) / (r.N + 1) for x in (r.n1_, r.N - r.n1_, r.n_1, r.N - r.n_1)]
        q1, q0, p1, p0 = share
        prior = [0.5, 0.5 * p0 / p1, 0.5 * q0 / q1, 0.5 * q0 * p0 / (q1 * p1)]
        p = rng.dirichlet(np.add(prior, [r.n11, r.n10, r.n01, r.n00]), 100_000)
        ic = np.log(p[:, 0] / ((p[:, 0] + p[:, 1]) * (p[:, 0] + p[:, 2])))
        expected = np.quantile(ic, [0.025, 0.5, 0.975])
        assert np.allclose([r.LB95_IC, r.median_IC, r.UB95_IC], expected, atol=0.05 * ic.std() + 0.002)
        assert abs(r.postH0 - np.mean(ic < 0)) < 0.015


def test_sampling_does_not_depend_on_partitioning(spark):
    t = disp.cells(sample(spark))
    results = []
    for n in (1, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            rows = bayes.bcpnn_mc(t.repartition(n), draws=200, seed=5).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        results.append(sorted((r.drug_code, r.event_effect, r.median_IC, r.LB95_IC, r.UB95_IC, r.postH0) for r in rows))
    assert results[0] == results[1] == results[2]
    other = bayes.bcpnn_mc(t, draws=200, seed=6).collect()
    assert results[0] != sorted((r.drug_code, r.event_effect, r.median_IC, r.LB95_IC, r.UB95_IC, r.postH0) for r in other)


def test_empty_cells_are_counted_without_forming_them(spark):
    ct = ct_of(spark, BASIC)
    e, n = shrinkage.empty_cells(ct)
    # (A, z) with 5 * 3 / 10 and (B, y) with 5 * 1 / 10
    assert n.sum() == 2 and math.isclose(float((e * n).sum()), 1.5 + 0.5, rel_tol=1e-9)


def test_prior_fit_climbs_and_recovers_a_known_prior(spark):
    rng = np.random.default_rng(11)
    drugs, events = 120, 90
    size_d, size_e = rng.lognormal(0, 0.8, drugs), rng.lognormal(0, 0.8, events)
    e = 6 * np.outer(size_d / size_d.mean(), size_e / size_e.mean())
    first = rng.random((drugs, events)) < 0.2
    rate = np.where(first, rng.gamma(2.0, 1.0, e.shape), rng.gamma(10.0, 1 / 11.0, e.shape))
    n = rng.poisson(rate * e)
    rows = [(f"d{i:03}", f"e{j:03}", int(n[i, j])) for i in range(drugs) for j in range(events) if n[i, j] > 0]
    ct = ct_of(spark, rows).cache()
    start = shrinkage.GammaMixture()
    fit = shrinkage.gps_fit(ct)
    again = shrinkage.gps_fit(ct, start=fit, max_steps=5)
    early = shrinkage.gps_fit(ct, start=start, max_steps=2)
    assert early.log_likelihood <= fit.log_likelihood <= again.log_likelihood + 1e-6
    means = sorted([(fit.alpha1 / fit.beta1, fit.w), (fit.alpha2 / fit.beta2, 1 - fit.w)])
    assert abs(means[1][1] - 0.2) < 0.1
    assert 1.5 < means[1][0] / means[0][0] < 3.0
    post = shrinkage.gps(ct, fit)
    bad = post.filter(
        ~(F.col("Q05_lambda") < F.col("postE_lambda")) | ~F.col("postH0").between(0, 1) | F.isnan("postE_log2_lambda")
    )
    assert bad.count() == 0
    ct.unpersist()


def test_gradient_of_the_likelihood():
    from sentria.functions.kernels import negative_binomial_sums

    rng = np.random.default_rng(0)
    n, e, cells = rng.poisson(3, 200).astype(float), rng.random(200) * 5 + 0.1, np.ones(200)
    v = np.array([0.3, -0.2, 1.1, 0.9, -0.4])
    value = negative_binomial_sums(n, e, cells, shrinkage.GammaMixture.from_vector(v).params())
    for i in range(5):
        step = np.eye(5)[i] * 1e-6
        up, down = (negative_binomial_sums(n, e, cells, shrinkage.GammaMixture.from_vector(v + d).params())[0] for d in (step, -step))
        assert math.isclose((up - down) / 2e-6, value[i + 1], rel_tol=1e-5, abs_tol=1e-4)


def test_error_rates_by_definition(spark):
    rng = np.random.default_rng(2)
    p = [round(float(x), 1) for x in rng.random(300)]  # many ties
    rows = [(f"d{i:03}", "e", x) for i, x in enumerate(p)]
    out = ranking.error_rates(spark.createDataFrame(rows, "drug_code string, event_effect string, postH0 double"))
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    m, total = len(rows), sum(p)
    for r in out.collect():
        i = r["rank"]
        assert ordered[i - 1][0] == r.drug_code
        head = sum(x[2] for x in ordered[:i])
        tail = sum(x[2] for x in ordered[i - 1 :])
        assert math.isclose(r.FDR, head / i, rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r.Se, (i - head) / (m - total), rel_tol=1e-9)
        assert math.isclose(r.Sp, tail / total, rel_tol=1e-9, abs_tol=1e-12)
        if i < m:
            assert math.isclose(r.FNR, ((m - i + 1) - tail) / (m - i), rel_tol=1e-9, abs_tol=1e-9)


def quarterly(spark):
    rows = [(20061, "A", "x", 2), (20061, "B", "y", 1), (20062, "B", "x", 3), (20063, "A", "x", 1), (20063, "A", "y", 4)]
    return spark.createDataFrame(rows, "quarter long, ing string, PT_NAME_ENG string, count long")


def test_cumulative_totals_carry_over_gaps(spark):
    t = plans.cumulative_contingency(quarterly(spark), "ing", "PT_NAME_ENG")
    got = {(r.quarter, r.drug_code, r.event_effect): (r.n11, r.n1_, r.n_1, r.N) for r in t.collect()}
    assert got[20062, "A", "x"] == (2, 2, 5, 6)  # absent in that quarter
    assert got[20063, "A", "x"] == (3, 7, 6, 11)
    assert got[20063, "B", "y"] == (1, 4, 5, 11)
    assert (20062, "A", "y") not in got and len(got) == 2 + 3 + 4


def test_last_cumulative_quarter_is_the_overall_table(spark):
    counts = quarterly(spark)
    last = plans.cumulative_contingency(counts, "ing", "PT_NAME_ENG").filter("quarter = 20063").drop("quarter")
    overall = contingency(
        counts.groupBy("ing", "PT_NAME_ENG").agg(F.sum("count").alias("count")), "ing", "PT_NAME_ENG"
    )
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, overall.collect()))


def test_one_quarter_equals_the_overall_statistics(spark):
    fact = spark.createDataFrame(
        [(i, f"d{i % 3}", f"e{i % 4}", 20061) for i in range(60)], "REPORT_ID long, ing string, PT_NAME_ENG string, quarter long"
    )
    whole = plans.signals(fact, "PT", exact=False, ordered=False)
    split = plans.signals(fact, "PT", by="quarter", exact=False, ordered=False).drop("quarter")
    assert sorted(map(repr, whole.select(sorted(whole.columns)).collect())) == sorted(
        map(repr, split.select(sorted(split.columns)).collect())
    )


def test_sampled_and_shrunk_master_table(spark):
    fact = spark.createDataFrame(
        [(i, f"d{i % 3}", f"e{i % 4}", 20061) for i in range(60)], "REPORT_ID long, ing string, PT_NAME_ENG string, quarter long"
    )
    t = plans.signals(fact, "PT", draws=100, seed=1, prior=shrinkage.GammaMixture())
    assert {"median_IC", "postH0", "gps_postH0", "Q05_lambda", "RFET", "midRFET"} <= set(t.columns)
    values = [r.median_IC for r in t.collect()]
    assert values == sorted(values, reverse=True) and len(values) == 12


def test_null_terms_drop_out_above_the_preferred_term(spark):
    fact = spark.createDataFrame([(1, "A", None), (2, "A", "h"), (2, "A", "h")], "REPORT_ID long, ing string, HLT_NAME_ENG string")
    assert [tuple(r) for r in pair_counts(fact, "HLT").collect()] == [("A", "h", 1)]


@pytest.mark.parametrize("name", ["d7_bcpnn_mc", "d8a_gps_fit"])
def test_queries_without_sql_run(name, spark, sf_dir):
    from sentria.plans.registry import registry

    assert registry()[name](spark, sf_dir).count() > 0


def test_threshold_query_against_brute_force(spark, sf_dir):
    from sentria.plans.registry import MARGIN, _pt_counts, registry

    pairs = [(r.DRUGNAME, r.PT_NAME_ENG, r["count"]) for r in _pt_counts(spark, sf_dir).collect()]
    got = {p: (r.n11, r.n1_, r.n_1) for p, r in by_pair(registry()["a6_contingency_threshold"](spark, sf_dir)).items()}
    assert got == fix_point(pairs, MARGIN)
