"""Toxicity: all maximal segments by brute force, and what few, one-sided or repeated labels teach."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentria.llm import toxicity


def _all_maximal(values, low=0):
    """The best stretch, then the best ones on both sides of it, as long as they score above 0."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    best = max(((sums[b] - sums[a], -a, -b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[1], -best[2]
    left, right = _all_maximal(values[:a], low), _all_maximal(values[b:], low + b)
    return [*left, (low + a, low + b, best[0]), *right]


@pytest.mark.parametrize("seed", range(40))
def test_all_maximal_segments(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 40)
    marked = sorted(rng.sample(range(n), rng.randrange(0, n + 1)))
    scores = [(k, rng.choice([rng.uniform(-1, 1), rng.uniform(0, 0.2), rng.uniform(-3, 0)])) for k in marked]
    values = np.full(n, -toxicity.DRIFT)
    for k, s in scores:
        values[k] += s
    got, want = toxicity.segments(scores), _all_maximal(values.tolist())
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    plain = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(120):
        words = rng.choices(plain, k=60)
        if k % 10 == 0:
            words[20:24] = rng.choices(["vile", "nasty", "rotten"], k=4)
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 10 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_few_labels_are_enough(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.where("doc_id < 100"))
    assert {"vile", "nasty", "rotten"} <= set(model.lexicon)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(found[k].score >= 0.3 for k in (100, 110)) and sum(found[k].score >= 0.3 for k in range(101, 110)) == 0
    assert [(p.start, p.end) for p in found[110].passages] == [(20, 24)]


def test_repeated_label_rows_change_nothing(labelled):
    docs, labels = labelled
    once, twice = toxicity.fit(docs, labels), toxicity.fit(docs, labels.unionByName(labels))
    assert once == twice


def test_one_class_or_no_text_finds_nothing(spark, labelled):
    docs, labels = labelled
    for some in (labels.where("toxic = 1"), labels.where("toxic = 0"), labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.fit(docs, some)
        assert model.lexicon == {} and toxicity.score(docs, model).where("score >= 0.3").count() == 0
    empty = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("")))
    assert toxicity.fit(empty, labels).lexicon == {}


def test_partitions_do_not_change_the_model(labelled):
    docs, labels = labelled
    one, many = toxicity.fit(docs.coalesce(1), labels), toxicity.fit(docs.repartition(13), labels)
    assert one.lexicon == many.lexicon and one.scale == pytest.approx(many.scale) and one.slope == pytest.approx(many.slope)
