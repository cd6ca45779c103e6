"""Quality classifier: logistic regression over hashed word n-grams, learned by
follow-the-regularised-leader updates, scored as sparse dot products."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.toxicity import _labelled, in_fold

#: Runs of letters, of digits and of other characters are words here.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BITS = 20
#: Labelled rows that the model is fitted on at most, the ones with the smallest hashes of doc_id.
MAX_LABELLED = 6_000
EPOCHS = 8
#: Cached words per worker; the cache starts anew beyond it.
CACHE_WORDS = 300_000
MASK = np.uint32((1 << BITS) - 1)
#: Shared feature of every word that repeats the one before.
SAME = np.uint32(zlib.crc32(b"\0same"))


class Hasher(dict):
    """word -> 32-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return value


_HASHES = Hasher()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of the words and pairs of words of a text; values have length 1.

    A pair of equal words is one feature whichever the word. Letters are lower-cased;
    runs of capitals add a feature of their own. No words: no features.
    """
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    look = _HASHES.__getitem__
    raw = np.fromiter(map(look, tokens), np.uint32, len(tokens))
    low = np.fromiter(map(look, map(str.lower, tokens)), np.uint32, len(tokens))
    pairs = low[:-1] * np.uint32(0x9E3779B1) + low[1:]
    pairs[low[:-1] == low[1:]] = SAME
    slots, counts = np.unique(np.concatenate([low, pairs, raw[raw != low] ^ np.uint32(0x5BD1E995)]) & MASK, return_counts=True)
    values = np.log1p(counts)
    return slots.astype(np.int64), values / np.sqrt((values**2).sum())


class FollowTheLeader:
    """Per-coordinate follow-the-regularised-leader for logistic loss, with l1 and l2."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.001):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # The last slot is the intercept.
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(
            np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        )

    def update(self, slots: np.ndarray, values: np.ndarray, y: float) -> None:
        w = self.weights(slots)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
        g = (p - y) * values
        sigma = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / self.alpha
        self.z[slots] += g - sigma * w
        self.n[slots] += g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> np.ndarray:
    """Weights, one per slot and the intercept. Without labelled rows all are 0, so every score is 0.5."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [features(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "y": batch["label"],
                    "slots": [s.astype(np.int32).tobytes() for s, _ in both],
                    "values": [v.astype(np.float32).tobytes() for _, v in both],
                }
            )

    # At most ``limit`` rows reach the driver.
    rows = _labelled(docs, labels, label, limit).mapInPandas(turn, "doc_id long, y int, slots binary, values binary")
    data = rows.toPandas().sort_values(["doc_id", "slots"], kind="stable")
    order = np.random.default_rng(7)
    model = FollowTheLeader()
    held = [
        (np.append(np.frombuffer(s, np.int32), 1 << BITS), np.append(np.frombuffer(v, np.float32), 0.25), float(y == 1))
        for s, v, y in zip(data["slots"], data["values"], data["y"])
    ]
    for _ in range(EPOCHS):
        for k in order.permutation(len(held)):
            model.update(*held[k])
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of ``docs`` and score, the probability of label 1. An existing score is replaced.

    Null or empty text has no features: its score is that of the intercept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        w = shared.value
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            slots, values = features(text)
            out[k] = w[slots] @ values + 0.25 * w[-1]
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return docs.drop("score").withColumn("score", judge("text"))


def op6_quality_model(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    weights = fit(docs, labels.where(~in_fold(0, 5)))
    return score(docs, weights).select(
        "doc_id",
        F.coalesce(in_fold(0, 5), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
