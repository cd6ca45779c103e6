"""Toxicity: significant toxic passages by maximum-scoring segments.

Every word has a log-odds score, toxic against clean documents, shrunk by a
Dirichlet prior from the common frequencies. One linear scan finds all maximal
scoring segments of a text. Scores of segments in clean text follow an
extreme-value law, which turns them into expected numbers of chance finds; the
evidence of all significant segments is summed and mapped to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that the model is fitted on at most, the ones with the smallest hashes of doc_id.
MAX_LABELLED = 20_000
#: Weight of the prior, as a share of the counts it is taken from.
PRIOR = 0.1
#: A word's score is its log-odds, moved by so many standard deviations towards 0.
CAUTION = 1.5
#: Words that score less, either way, count as neutral.
MIN_SCORE = 0.5
#: Score that every word costs; it ends passages.
DRIFT = 0.05
#: Parts of the labelled rows. Each is scored by what the others teach, for the extreme-value law and the calibration.
FOLDS = 5
#: A segment is significant if so many or fewer are expected by chance in the text.
MAX_E = 0.05
#: Tokens gathered in a task before the counts are handed on.
FLUSH_WORDS = 1_000_000


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    scale: float = 1e-4
    intercept: float = -3.0
    slope: float = 1.0

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * np.log1p(evidence), -30, 30)))


def segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time.

    ``scores`` has (position, score) of the words that are not neutral, in order;
    every word also costs ``drift``.
    """
    found: list[list[float]] = []  # start, end, sum before, sum after
    total, last = 0.0, -1
    for at, score in scores:
        total -= drift * (at - last - 1)
        last = at
        before = total
        total += score - drift
        if score <= drift:
            continue
        new = [at, at + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            # found[j] began lower: if it also ended lower, the two are one segment.
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(a), int(b), r - l) for a, b, l, r in found]


def evidence_of(text: str | None, model: Model) -> tuple[float, int, list[tuple[int, int, float]]]:
    """(evidence, words, significant segments) of a text."""
    tokens = WORD.findall((text or "").lower())
    get = model.lexicon.get
    marked = [(k, s) for k, t in enumerate(tokens) if (s := get(t)) is not None]
    if not marked:
        return 0.0, len(tokens), []
    floor = math.log(model.scale * len(tokens))
    kept, evidence = [], 0.0
    for a, b, s in segments(marked):
        excess = model.rate * s - floor  # minus the logarithm of the number expected by chance
        if excess >= -math.log(MAX_E):
            kept.append((a, b, s))
            evidence += excess
    return evidence, len(tokens), kept


def _labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled documents; which ones depends on their ids alone."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    # Bounded by ``limit`` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): per part of ``FOLDS``, the documents labelled 1 and 0 that have the word, as arrays.

    A word that one document repeats is no more typical of its label for it.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter[tuple[str, int, int]] = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, n) for k, n in sums.items()], columns=["word", "fold", "y", "n"])
            sums.clear()
            return out

        for batch in batches:
            for text, fold, y in zip(batch["text"], batch["fold"], batch["label"]):
                sums.update((w, fold, int(y == 1)) for w in set(WORD.findall((text or "").lower())))
            if len(sums) > FLUSH_WORDS:
                yield flush()
        yield flush()

    found = rows.mapInPandas(count, "word string, fold int, y int, n long")
    of = lambda y: F.array(
        *[F.sum(F.when((F.col("y") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)) for k in range(FOLDS)]
    )
    return found.groupBy("word").agg(of(1).alias("toxic"), of(0).alias("clean"))


def _odds(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """Score and share of clean text of a word: log-odds from document counts, moved towards 0 by their uncertainty."""
    prior = F.lit(PRIOR) * (toxic + clean)
    extra = PRIOR * (all_toxic + all_clean)
    a, b = toxic + prior, clean + prior
    odds = F.log(a / (F.lit(all_toxic + extra) - a)) - F.log(b / (F.lit(all_clean + extra) - b))
    shrunk = F.signum(odds) * F.greatest(F.abs(odds) - CAUTION * F.sqrt(1 / a + 1 / b), F.lit(0.0))
    return F.struct(F.when(toxic + clean > 0, shrunk).otherwise(0.0).alias("odds"), (b / (all_clean + extra)).alias("share"))


def _rate(lexicon: dict[str, float], share: dict[str, float]) -> float:
    """Decay of segment scores in clean text: the positive root of sum p * exp(rate * score) = 1."""
    s = np.array([lexicon[w] for w in lexicon])
    p = np.array([share[w] for w in lexicon])
    if not (s > DRIFT).any():
        return 1.0
    rest = 1 - p.sum()
    f = lambda x: float((p * np.exp(x * (s - DRIFT))).sum() + rest * math.exp(-x * DRIFT) - 1)
    low, high = 1e-6, 1.0
    if f(low) > 0:  # no negative drift in clean text: scores cannot be told from chance
        return 1e-3
    while f(high) < 0:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _scale(calm: pd.DataFrame, rate: float, least: float) -> float:
    """Scale of the extreme-value law by maximum likelihood, given its rate.

    The best score of a clean text of n words stays below s with probability
    exp(-scale * n * exp(-rate * s)). Texts without a segment stay below ``least``.
    """
    hits = calm["top"] > 0
    exposure = (calm["n"] * np.exp(-rate * calm["top"].where(hits, least - DRIFT))).sum()
    return float(max(1e-12, max(hits.sum(), 0.5) / max(exposure, 1e-12)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_LABELLED) -> Model:
    """Learn lexicon, extreme-value law and calibration from labelled documents.

    Without labelled rows, or with one class alone, the model finds nothing toxic.
    """
    rows = _labelled(docs, labels, label, limit).withColumn(
        "fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    )
    model = Model()
    # The words of at most ``limit`` documents that are in two of them; a single document proves nothing.
    enough = F.aggregate(F.concat("toxic", "clean"), F.lit(0).cast("long"), lambda n, x: n + x) > 1
    sums = word_counts(rows).cache()
    totals = sums.agg(
        *[F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}") for c in ("toxic", "clean") for k in range(FOLDS)]
    ).first()
    all_toxic, all_clean = ([totals[f"{c}{k}"] or 0 for k in range(FOLDS)] for c in ("toxic", "clean"))
    if not sum(all_toxic) or not sum(all_clean):  # also without any words
        sums.unpersist()
        return model

    def taught(left_out: int | None) -> Column:
        """What the parts teach, without one of them."""
        own = [k for k in range(FOLDS) if k != left_out]
        t, c = sum(all_toxic[k] for k in own), sum(all_clean[k] for k in own)
        if not t or not c:
            return F.struct(F.lit(0.0).alias("odds"), F.lit(0.0).alias("share"))
        count = lambda name: sum((F.get(name, F.lit(k)) for k in own), F.lit(0)).cast("double")
        return _odds(count("toxic"), count("clean"), t, c)

    scores = F.array(*[taught(k) for k in (None, *range(FOLDS))])
    some = sums.where(enough).select("word", scores.alias("s")).where(F.exists("s", lambda s: F.abs(s["odds"]) >= MIN_SCORE))
    # The words that tell the classes apart, of at most ``limit`` documents.
    kept = some.sort("word").collect()
    sums.unpersist()
    lexica = [{r.word: r.s[k].odds for r in kept if abs(r.s[k].odds) >= MIN_SCORE} for k in range(FOLDS + 1)]
    model.lexicon = lexica[0]
    model.rate = _rate(model.lexicon, {r.word: r.s[0].share for r in kept})
    others = docs.sparkSession.sparkContext.broadcast(lexica[1:])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, fold, y in zip(batch["text"], batch["fold"], batch["label"]):
                own = others.value[fold]
                tokens = WORD.findall((text or "").lower())
                marked = [(k, s) for k, t in enumerate(tokens) if (s := own.get(t)) is not None]
                out.append((int(y == 1), len(tokens), [s for *_, s in segments(marked)]))
            yield pd.DataFrame(out, columns=["y", "n", "scores"])

    # At most ``limit`` rows of a few numbers each, summed in one order.
    seen = rows.mapInPandas(best, "y int, n long, scores array<double>").toPandas()
    seen = seen.assign(top=[max(s, default=0.0) for s in seen["scores"]]).sort_values(["y", "n", "top"])
    model.scale = _scale(seen[seen["y"] == 0], model.rate, min((s for s in model.lexicon.values() if s > DRIFT), default=1.0))
    evidence = np.array(
        [
            sum(e for s in scores if (e := model.rate * s - math.log(model.scale * max(n, 1))) >= -math.log(MAX_E))
            for scores, n in zip(seen["scores"], seen["n"])
        ]
    )
    model.intercept, model.slope = _logistic(np.log1p(evidence), seen["y"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Newton's method with a small ridge."""
    design = np.column_stack([np.ones_like(x), x])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.1 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, score (0 to 1) and passages (start, end in words, score).

    Null or empty text has no passage and the score of no evidence. Columns named
    score or passages are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages array<struct<start:long,end:long,score:double>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        found = [evidence_of(t, own) for t in texts]
        return pd.DataFrame(
            {
                "score": own.probability(np.array([e for e, *_ in found], float)),
                "passages": [[{"start": a, "end": b, "score": s} for a, b, s in kept] for *_, kept in found],
            }
        )

    own = docs.drop("score", "passages")
    return own.withColumn("__t", judge("text")).select(*own.columns, "__t.score", "__t.passages")


def in_fold(fold: int, folds: int):
    """Whether crc32 of the id's text leaves this remainder."""
    return F.crc32(F.col("doc_id").cast("string")) % folds == fold


def fit_held_out(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from labelled rows outside the held-out fourth."""
    return fit(docs, labels.where(~in_fold(2, 4)))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, fit_held_out(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(in_fold(2, 4), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
