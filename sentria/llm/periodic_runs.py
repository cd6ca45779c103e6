"""Periodic runs: stretches of words that repeat with a short period, by maximal pairs.

The words of several documents form one array, in which no document shares a symbol
with another. Prefix doubling sorts its suffixes and gives the common prefixes of
neighbours. The tree of intervals with a common prefix is walked bottom-up; an
interval keeps its places in order, and the class of a place is the word to its left.
Two places from different children and of different classes are a maximal pair: its
common prefix can grow at neither end. If the distance d and the prefix length l have
l >= (exponent - 1) * d, the words from the first place to the end of the second
prefix are a run of period d, and every run is found so; nothing is extended.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import table

MIN_LENGTH = 6
EXPONENT = 4
#: Words that are sorted together; a longer document is sorted alone. It bounds memory, not results.
TOGETHER = 1 << 18

Run = tuple[int, int, int]
RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def prefix_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Rank of every suffix by its first 1, 2, 4, ... symbols, until all ranks differ.

    A rank is the number of suffixes that are smaller, so equal ranks mean equal
    prefixes. Symbols are 0, 1, ... without gaps, and the last one occurs once.
    """
    size = np.bincount(codes)
    rank = (np.cumsum(size) - size)[codes].astype(np.int32)
    levels, step = [rank], 1
    open_ = np.flatnonzero(size[codes] > 1)
    while len(open_):
        # An open suffix shares its first ``step`` symbols, so it is longer than that.
        key = rank[open_].astype(np.int64) * len(codes) + rank[open_ + step]
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        old = rank[open_]
        at = np.arange(len(open_))
        first = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(first, at, 0))
        outer = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        rank = rank.copy()
        rank[open_] = old + group - outer
        levels.append(rank)
        alone = first & np.r_[first[1:], True]
        open_ = open_[~alone]
        step *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes, pair by pair."""
    length = np.zeros(len(one), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][one + length] == levels[k][two + length]).astype(np.int64) << k
    return length


class PairWalk:
    """Maximal pairs of the intervals of one array, kept as the run they are, with its smallest distance."""

    def __init__(self, left: list[int], min_length: int, exponent: int):
        self.left, self.min_length, self.exponent = left, min_length, exponent
        self.found: dict[tuple[int, int], int] = {}

    def _pair(self, one: int, two: int, depth: int) -> None:
        if two - one + depth >= self.min_length:
            place = (one, two + depth)
            self.found[place] = min(two - one, self.found.get(place, depth))

    def _join(self, a: list[int], b: list[int], depth: int) -> list[int]:
        """Pairs between two children of an interval, and their places in order.

        Places of equal prefixes at a distance of at most its length lie in one row
        with a fixed step, so all but the first of a row have one class.
        """
        small, large = (a, b) if len(a) < len(b) else (b, a)
        left, reach = self.left, depth // (self.exponent - 1)
        for p in small:
            k = bisect_right(large, p)
            after = k
            while after < len(large) and large[after] - p <= reach and left[large[after]] != left[p]:
                self._pair(p, large[after], depth)
                after += 1
            before = bisect_left(large, p - reach)
            if before < k and left[large[before]] != left[p]:
                self._pair(large[before], p, depth)
        if len(small) == 1:
            large.insert(bisect_left(large, small[0]), small[0])
        else:
            large += small
            large.sort()
        return large

    def walk(self, places: list[int], depths: list[int]) -> None:
        """All intervals of a stretch of the suffix array, children before parents."""
        inner: list[tuple[int, list[int]]] = []
        node = [places[0]]
        for place, depth in zip([*places[1:], -1], [*depths, 0]):
            while inner and inner[-1][0] > depth:
                d, spots = inner.pop()
                node = self._join(spots, node, d)
            if inner and inner[-1][0] == depth:
                node = self._join(inner.pop()[1], node, depth)
            inner.append((depth, node))
            node = [place]


def runs_of(texts: list[list], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[list[Run]]:
    """(start, length, period) of every run of each sequence, by start, then period.

    A run has a smallest period p, a length of at least ``min_length`` and
    ``exponent * p`` (2 or more), and its neighbours do not keep the period.
    """
    fresh = count()
    codes, starts = [next(fresh)], []
    for words in texts:
        starts.append(len(codes))
        codes.extend(map(defaultdict(fresh.__next__).__getitem__, words))
        codes.append(next(fresh))
    array = np.array(codes)
    levels = prefix_ranks(array)
    places = np.empty(len(array), np.int64)
    places[levels[-1]] = np.arange(len(array))
    # The shortest prefix that any run of these bounds has.
    least = min(max((exponent - 1) * p, min_length - p) for p in range(1, min_length + 1))
    out: list[list[Run]] = [[] for _ in texts]
    coarse = min(len(levels) - 1, least.bit_length() - 1)
    near = np.flatnonzero(levels[coarse][places[:-1]] == levels[coarse][places[1:]])
    depth = common_prefixes(levels, places[near], places[near + 1])
    near, depth = near[depth >= least], depth[depth >= least]
    if not len(near):
        return out
    pairs = PairWalk([-1, *codes[:-1]], min_length, exponent)
    cuts = np.flatnonzero(np.diff(near) > 1) + 1
    for at, deep in zip(np.split(near, cuts), np.split(depth, cuts)):
        pairs.walk(places[at[0] : at[-1] + 2].tolist(), deep.tolist())
    found = sorted((one, period, end) for (one, end), period in pairs.found.items())
    owner = np.searchsorted(starts, [one for one, _, _ in found], side="right") - 1
    for k, (one, period, end) in zip(owner.tolist(), found):
        out[k].append((one - starts[k], end - one, period))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, of every run its first period only."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])


def periodic_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    exponent: int = EXPONENT,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start, then period) and the collapsed text of every row.

    Words are what stands between white space; ``prepare`` may change the words of a
    document before. A null or empty text has no runs and an empty collapsed text. Rows
    are taken one by one, so repeated rows and missing doc_ids need no care. No rows
    give none; other columns are ignored.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def result(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
            runs = runs_of(texts, min_length, exponent)
            names = ("start", "length", "period")
            return pd.DataFrame(
                {
                    "doc_id": pd.array(ids, dtype="Int64"),
                    "runs": [[dict(zip(names, r)) for r in own] for own in runs],
                    "collapsed": [collapse(w, own) for w, own in zip(texts, runs)],
                }
            )

        for batch in batches:
            ids, texts, n = [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                own = None if pd.isna(doc_id) else int(doc_id)
                words = (text or b"").split()
                words = prepare(own, words) if prepare else words
                if texts and n + len(words) > TOGETHER:
                    yield result(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(own)
                texts.append(words)
                n += len(words)
            if texts:
                yield result(ids, texts)

    # doc_id as text: a column with nulls would reach the task as doubles.
    slim = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInPandas(find, RUNS).withColumn("collapsed", F.col("collapsed").cast("string"))


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by the checksum of its doc_id, repeats a stretch of words up to its end."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """All documents, those with a periodic tail included: the longest run, and checksums of all runs and the collapsed text."""
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), prepare=periodic_tail)
    top = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.n").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.n") / -F.col("top.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
