"""LM scoring: online logistic mixing of hashed-context bit predictors.

A text is its words, A-Z in lower case, each closed by a space, and an empty word
as its end. Every bit of these bytes is predicted by counts under hashed contexts:
the last two to six bytes of the word, and the word so far. A gate picks the
weights by which the predictions are mixed in the logistic domain; the weights
follow the error online, and an adaptive map refines the mix. Contexts end at word
borders, so that each distinct word is coded once, however often it occurs, and the
work follows the vocabulary. Counts come from every training word of the corpus.
Inside a text a last, adaptive predictor expects what followed the word before when
it last occurred; its mixture with the word's own probability is the text's score.

While weights are learned, a word's own occurrence is taken out of the counts, so
that they learn what the predictors are worth on unseen text.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import staged

#: Bytes that the context predictors look back, within the word.
ORDERS = (2, 3, 4, 6)
#: Slots (as a power of two) of the predictors: one per order and the word so far. Fixed: contexts share slots.
SLOTS = (20, 20, 20, 21, 22)
INPUTS = len(SLOTS) + 1
CHUNK = 1 << 16
#: Chunks that pass the driver at a time: 8 MB before compression.
PIECE = 16
PIECES = -(-sum((1 << b) // CHUNK for b in SLOTS) // PIECE)
#: A weight moves so far at most in one step.
MOST = 0.02
GATES = 64
BINS = 33
#: Bytes coded at once, and words a task counts before it hands on.
STEP_BYTES = 20_000
FLUSH_WORDS = 400_000
#: Words whose scores every worker holds; the rest are joined by shuffle.
HEAD_WORDS = 1 << 18
#: Words of documents scored at a time, about.
GROUP_WORDS = 1 << 17
#: Chance of a hit before any is seen, by the logarithm of the run of hits so far.
FIRST = (0.01, 0.3, 0.7, 0.9, 0.97)
MULT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LN = 1 / math.log(2)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


@dataclass
class Model:
    """Counts of each predictor (a row of zeros and ones per slot), gate weights and the adaptive map (ones, all)."""

    counts: list[np.ndarray] = field(default_factory=lambda: [np.zeros((1 << b, 2), np.float32) for b in SLOTS])
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, INPUTS), 0.2))
    refined: np.ndarray = field(default_factory=lambda: np.zeros((2, GATES, BINS)))


@dataclass
class Batch:
    """Words laid end to end: bytes, hashes of each byte's contexts, and where words begin."""

    symbols: np.ndarray
    contexts: list[np.ndarray]
    starts: np.ndarray
    word_of: np.ndarray


def lay_out(words: list[bytes]) -> Batch:
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    lengths = np.array([len(w) + 1 for w in words])
    starts = np.cumsum(lengths) - lengths
    word_of = np.repeat(np.arange(len(words)), lengths)
    inside = np.arange(len(flat)) - starts[word_of]
    contexts, h = [], np.zeros(len(flat), np.uint64)
    for k in range(1, max(ORDERS) + 1):
        back = np.zeros(len(flat), np.uint64)
        back[k:] = flat[:-k].astype(np.uint64) + np.uint64(1)
        back[inside < k] = 0
        h = (h + back) * MULT
        h ^= h >> np.uint64(29)
        if k in ORDERS:
            contexts.append(h + np.uint64(k))
    # Hash of the word so far, from one running sum for all words.
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(flat), MULT, np.uint64))
        down = np.cumprod(np.full(len(flat), INVERSE, np.uint64))
        total = np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up)
        before = np.concatenate([[np.uint64(0)], total[:-1]])
        prefix = (before - before[starts][word_of]) * down[starts][word_of]
    prefix ^= prefix >> np.uint64(32)
    contexts.append(prefix * MULT + np.uint64(7))
    return Batch(flat, contexts, starts, word_of)


def _slots(batch: Batch, node: np.ndarray) -> list[np.ndarray]:
    mixed = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return [((c ^ mixed) * MULT >> np.uint64(64 - b)).astype(np.int64) for c, b in zip(batch.contexts, SLOTS)]


def bits(batch: Batch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For each of the eight bits: its value at every byte and the slots of its contexts."""
    for j in range(8):
        node = (1 << j) | (batch.symbols.astype(np.int64) >> (8 - j))
        yield (batch.symbols >> (7 - j)) & 1, _slots(batch, node)


def predict(model: Model, bit: np.ndarray, slots: list[np.ndarray], own: np.ndarray | float = 0.0):
    """(inputs, gate, probability of a one) at every byte; ``own`` occurrences of the bit are taken out."""
    inputs = np.empty((INPUTS, len(bit)))
    seen = []
    for k, (table, at) in enumerate(zip(model.counts, slots)):
        pair = np.take(table, at, axis=0)
        ones = np.maximum(pair[:, 1] - own * bit, 0)
        zeros = np.maximum(pair[:, 0] - own * (1 - bit), 0)
        inputs[k] = np.log((ones + 0.02) / (zeros + 0.02))
        seen.append(ones + zeros)
    inputs[-1] = 0.3
    level = lambda n: np.minimum(np.frexp(n + 1)[1] - 1, 15) >> 1  # half the whole logarithm
    gate = level(seen[-1]).astype(np.int64) * 8 + level(seen[3])
    mixed = np.zeros(len(bit))
    for weight, x in zip(np.ascontiguousarray(model.weights.T), inputs):
        mixed += weight[gate] * x
    return inputs, gate, 1 / (1 + np.exp(-np.clip(mixed, -20, 20)))


def _bin(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((np.log(p / (1 - p)) + 8) * (BINS - 1) / 16), 0, BINS - 1).astype(np.int64)


def refine(model: Model, gate: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Mean of the mix and of what followed in training when gate and mix were like this."""
    at = _bin(p)
    ones, n = model.refined[0, gate, at], model.refined[1, gate, at]
    return np.clip((p + (ones + 64 * p) / (n + 64)) / 2, 1e-9, 1 - 1e-9)


def word_bits(model: Model, words: list[bytes]) -> np.ndarray:
    """Bits that each word takes, its closing space included."""
    batch = lay_out(words)
    cost = np.zeros(len(batch.symbols))
    for bit, slots in bits(batch):
        _, gate, p = predict(model, bit, slots)
        p = refine(model, gate, p)
        cost -= np.log(np.where(bit == 1, p, 1 - p)) * LN
    return np.add.reduceat(cost, batch.starts)


class Learner:
    """Online updates of gate weights, a step per bit position and batch."""

    def __init__(self, model: Model, rate: float = 0.7):
        self.model, self.rate, self.steps = model, rate, 0
        self.mass = np.zeros(GATES)

    def learn(self, batch: Batch, weight: np.ndarray) -> None:
        model, per_byte = self.model, weight[batch.word_of]
        for bit, slots in bits(batch):
            inputs, gate, p = predict(model, bit, slots, 1.0)
            miss = (bit - p) * per_byte
            mass = np.bincount(gate, per_byte, GATES)
            slope = np.stack([np.bincount(gate, miss * x, GATES) for x in inputs], axis=1)
            # Normalised by the trace of the curvature, so that the step suits every gate.
            energy = np.bincount(gate, per_byte * p * (1 - p) * (inputs**2).sum(axis=0), GATES)
            self.steps += 1
            step = self.rate * slope / (energy + mass * 1e-3 + 1e-6)[:, None]
            model.weights += np.clip(step, -MOST, MOST)
            self.mass += mass
            q = _bin(p)
            place = gate * BINS + q
            model.refined[0] += np.bincount(place, per_byte * bit, GATES * BINS).reshape(GATES, BINS)
            model.refined[1] += np.bincount(place, per_byte, GATES * BINS).reshape(GATES, BINS)


def _batches(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows in runs of about ``STEP_BYTES``."""
    size = frame["word"].map(len).to_numpy() + 1
    run = np.cumsum(size) // STEP_BYTES
    for _, part in frame.groupby(run, sort=False):
        yield part


def first_places(texts: list[list[bytes]]) -> np.ndarray:
    """For texts laid end to end: the place where each word occurs first in its own text."""
    places: list[int] = []
    for words in texts:
        first: dict[bytes, int] = {}
        places += [first.setdefault(w, k) for k, w in enumerate(words, len(places))]
    return np.array(places, np.int64)


def repeats(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asked, hit, p) per word of a text: adaptive prediction by what followed the word before, last time.

    Where the word before has occurred already (asked), its last follower is
    expected with probability p. p starts from ``FIRST`` and follows the hits in
    this text, apart for each length of the current run of hits.
    """
    return repeats_of(first_places([words]), np.zeros(len(words), np.int64))


def repeats_of(ids: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``repeats`` for texts laid end to end, from ``first_places`` and the number of each word's text.

    The end, which occurs once in a text, keeps one text from the next.
    """
    order = np.argsort(ids, kind="stable")
    before = np.full(len(ids), -1)
    again = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    asked, hit = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    asked[1:] = before[:-1] >= 0
    hit[1:] = asked[1:] & (ids[before[:-1] + 1] == ids[1:])
    place = np.arange(len(ids))
    last_miss = np.maximum.accumulate(np.where(hit, -1, place))
    run = np.zeros(len(ids), np.int64)
    run[1:] = place[:-1] - last_miss[:-1]
    level = np.minimum(np.log2(run + 1), len(FIRST) - 1).astype(np.int64)
    p = np.zeros(len(ids))
    for k, first in enumerate(FIRST):
        own = np.flatnonzero(asked & (level == k))
        if len(own):
            hits = np.cumsum(hit[own]) - hit[own]
            begins = np.flatnonzero(np.diff(text_of[own], prepend=-1))
            begin = np.repeat(begins, np.diff(begins, append=len(own)))
            p[own] = (hits - hits[begin] + 8 * first) / (np.arange(len(own)) - begin + 8)
    return asked, hit, p


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, c, total): occurrences in training rows and in all rows; the end is the empty word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        other, every = Counter(), Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(every), "total": list(every.values())})
            out["c"] = [n - other.get(w, 0) for w, n in every.items()]
            other.clear(), every.clear()
            return out[["word", "c", "total"]]

        for batch in batches:
            for text, train in zip(batch["text"], batch["train"]):
                found = words_of(text)
                found.append(b"")
                every.update(found)
                if not train:
                    other.update(found)
            if len(every) > FLUSH_WORDS:
                yield flush()
        if every:
            yield flush()

    counted = docs.select("text", "train").mapInPandas(count, "word binary, c long, total long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def gather_counts(words: DataFrame) -> DataFrame:
    """(piece, k, chunk, part): counts of all contexts in all training words, in compressed chunks of tables of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(2 << b) for b in SLOTS]
        for frame in batches:
            for part in _batches(frame):
                batch = lay_out(part["word"].tolist())
                weight = part["c"].to_numpy(np.float64)[batch.word_of]
                for bit, slots in bits(batch):
                    for table, at in zip(sums, slots):
                        np.add.at(table, at * 2 + bit, weight)
        press = zstandard.ZstdCompressor(level=1)
        for k, table in enumerate(sums):
            for n, at in enumerate(range(0, len(table), 2 * CHUNK)):
                part = table[at : at + 2 * CHUNK].astype(np.float32)
                if part.any():
                    yield pd.DataFrame({"k": [k], "chunk": [n], "part": [press.compress(part.tobytes())]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 * CHUNK, np.float64)
        for part in frame["part"]:
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.float32)
        part = zstandard.ZstdCompressor(level=1).compress(total.astype(np.float32).tobytes())
        k, chunk = frame["k"].iloc[0], frame["chunk"].iloc[0]
        piece = (sum((1 << b) // CHUNK for b in SLOTS[:k]) + chunk) // PIECE
        return pd.DataFrame({"piece": [piece], "k": [k], "chunk": [chunk], "part": [part]})

    parts = words.where("c > 0").select("word", "c").mapInPandas(count, "k int, chunk int, part binary")
    return parts.groupBy("k", "chunk").applyInPandas(add, "piece int, k int, chunk int, part binary")


def send(counts: DataFrame) -> tuple[str, list[Broadcast]]:
    """A name and the broadcasts of all chunks of ``gather_counts``, as many whatever the corpus.

    The driver holds one piece at a time, as Arrow batches and not as rows.
    """
    spark = counts.sparkSession
    stored = staged(counts, "context-counts")
    pieces = []
    for n in range(PIECES):
        own = stored.where(F.col("piece") == n).select("k", "chunk", "part").toArrow()
        pieces.append(spark.sparkContext.broadcast(list(zip(*(own.column(c).to_pylist() for c in own.column_names)))))
    return uuid.uuid4().hex, pieces


#: The tables a worker has unpacked last, with the name they were sent under.
_UNPACKED: dict[str, list[np.ndarray]] = {}


def unpacked(sent: tuple[str, list[Broadcast]]) -> list[np.ndarray]:
    """Tables from their compressed chunks; kept for the worker's next tasks."""
    name, pieces = sent
    if name not in _UNPACKED:
        _UNPACKED.clear()
        tables = Model().counts
        for piece in pieces:
            for k, chunk, part in piece.value:
                raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.float32)
                tables[k][chunk * CHUNK : (chunk + 1) * CHUNK] = raw.reshape(-1, 2)
        _UNPACKED[name] = tables
    return _UNPACKED[name]


def learn(words: DataFrame, tables) -> tuple[np.ndarray, np.ndarray]:
    """Gate weights and adaptive map from all training words; tasks learn apart and are averaged by mass.

    ``tables`` is what ``send`` gives.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learner = Learner(Model(counts=unpacked(tables)))
        for frame in batches:
            for part in _batches(frame):
                learner.learn(lay_out(part["word"].tolist()), part["c"].to_numpy(np.float64))
        state = np.concatenate(
            [(learner.model.weights * learner.mass[:, None]).ravel(), learner.mass, learner.model.refined.ravel()]
        )
        yield pd.DataFrame({"place": np.arange(len(state)), "value": state})

    rows = words.where("c > 0").select("word", "c").mapInPandas(run, "place int, value double")
    summed = rows.groupBy("place").agg(F.sum("value").alias("value")).toPandas().sort_values("place")["value"].to_numpy()
    model = Model(counts=[])
    if len(summed):
        a, b = GATES * INPUTS, GATES * INPUTS + GATES
        mass = summed[a:b]
        model.weights[mass > 0] = summed[:a].reshape(GATES, INPUTS)[mass > 0] / mass[mass > 0, None]
        model.refined = summed[b:].reshape(2, GATES, BINS)
    return model.weights, model.refined


def score_words(words: DataFrame, tables, weights: np.ndarray, refined: np.ndarray) -> DataFrame:
    """(word, c, total, score): score is the word's log10 probability."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(unpacked(tables), weights, refined)
        for frame in batches:
            for part in _batches(frame):
                yield part.assign(score=-word_bits(model, part["word"].tolist()) * math.log10(2))

    return words.mapInPandas(run, "word binary, c long, total long, score double")


def head_of(scored: DataFrame) -> pa.Table:
    """word, c, score of the ``HEAD_WORDS`` words with the greatest ``total``; ties are cut by the word.

    Words too rare to be among them are left out before the sort, by the binary
    logarithm of ``total``, and the sort ends in a task: ``collect`` and ``toPandas``
    without Arrow would bring ``HEAD_WORDS`` rows of every partition to the driver.
    """
    level = F.floor(F.log2("total"))
    # One row per power of two.
    sizes = {r["level"]: r["n"] for r in scored.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    least, n = 0, 0
    for least in sorted(sizes, reverse=True):
        n += sizes[least]
        if n >= HEAD_WORDS:
            break
    often = scored.where(level >= least).orderBy(F.col("total").desc(), "word").limit(HEAD_WORDS)
    return often.select("word", "c", "score").toArrow()


#: The head a worker has unpacked last, with the name it was sent under.
_HEAD: dict[str, tuple] = {}


def unpacked_head(sent: tuple[str, bytes], below: float) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """(places of the words, base scores, scores, whether known); kept for the worker's next tasks."""
    name, raw = sent
    if name not in _HEAD:
        _HEAD.clear()
        with pa.ipc.open_stream(raw) as stream:
            head = stream.read_all()
        c = head.column("c").to_numpy()
        index = {w: k for k, w in enumerate(head.column("word").to_pylist())}
        _HEAD[name] = index, np.log10(c + 0.5) - below, head.column("score").to_numpy(), c > 0
    return _HEAD[name]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, list[list[bytes]]]]:
    """doc_ids and words, the end included, of documents in runs of about ``GROUP_WORDS`` words."""
    for batch in batches:
        begin, texts, n = 0, [], 0
        for k, text in enumerate(batch["text"], 1):
            texts.append([*words_of(text), b""])
            n += len(texts[-1])
            if n >= GROUP_WORDS or k == len(batch):
                yield batch["doc_id"].iloc[begin:k], texts
                begin, texts, n = k, [], 0


def score_documents(docs: DataFrame, train) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every row.

    ``train`` is the condition on rows to learn from; a null counts as false. Null or
    empty text is its end alone. Every row has its own result, also where doc_ids
    repeat or are null. Without training rows all counts are 0: the base score is
    that of an empty vocabulary, the model's that of an untrained mix. ``n_bytes``
    is the length of the coded form, for bits per byte. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    words = staged(vocabulary(rows), "vocabulary")
    n, v = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tables = send(gather_counts(words))
    scored = staged(score_words(words, tables, *learn(words, tables)), "word-scores")
    below = math.log10(n + 0.5 * (v + 1))
    head = head_of(scored)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as stream:
        stream.write_table(head)
    held = spark.sparkContext.broadcast((uuid.uuid4().hex, sink.getvalue().to_pybytes()))
    del head, sink

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        index, base, score, known = unpacked_head(held.value, below)
        # Place -1 is for words outside the head.
        base, score, known = np.append(base, 0.0), np.append(score, 0.0), np.append(known, False)
        row = TaskContext.get().partitionId() << 40
        for doc_ids, texts in _groups(batches):
            found = [w for words in texts for w in words]
            n_tokens = np.array([len(words) for words in texts])
            starts = np.cumsum(n_tokens) - n_tokens
            text_of = np.repeat(np.arange(len(texts)), n_tokens)
            at = np.array([index.get(w, -1) for w in found], np.int64)
            ids = first_places(texts)
            asked, hit, p = repeats_of(ids, text_of)
            alone = score[at]
            own = np.where(asked, np.log10(np.maximum(1 - p, 1e-12)), 0.0) + alone
            # A hit is also coded by its own probability, which is nothing outside the head.
            own[hit] = np.log10(p[hit] + (1 - p[hit]) * np.where(at[hit] >= 0, 10.0 ** alone[hit], 0.0))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            documents = {
                "row": row + np.arange(len(texts)),
                "doc_id": doc_ids.astype("Int64").array,
                "n_tokens": n_tokens,
                "n_known": np.add.reduceat(known[at].astype(np.int64), starts),
                "base": np.add.reduceat(base[at], starts),
                "score": np.add.reduceat(own, starts),
                "n_bytes": np.add.reduceat(sizes + 1, starts),
                "word": None,
            }
            yield pd.DataFrame(documents)
            # Words outside the head: one row per document and word, with times found and times not hit.
            far = np.flatnonzero(at < 0)
            if len(far):
                word, times = np.unique(ids[far], return_counts=True)
                tails = {
                    "row": row + text_of[word],
                    "doc_id": pd.array([None] * len(word), "Int64"),
                    "n_tokens": times,
                    "n_known": np.bincount(ids[far], ~hit[far], len(found))[word].astype(np.int64),
                    "base": 0.0,
                    "score": 0.0,
                    "n_bytes": 0,
                    "word": [found[k] for k in word.tolist()],
                }
                yield pd.DataFrame(tails)
            row += len(texts)

    parts = staged(
        rows.select("doc_id", "text").mapInPandas(
            sum_up,
            "row long, doc_id long, n_tokens long, n_known long, base double, score double, n_bytes long, word binary",
        ),
        "document-parts",
    )
    times = F.col("t.n_tokens")
    tail = (
        parts.where("word is not null").select("row", "n_tokens", F.col("n_known").alias("coded"), "word").alias("t")
        .join(scored.alias("s"), F.col("t.word") == F.col("s.word"))
        .groupBy("t.row")
        .agg(
            F.sum(F.when(F.col("s.c") > 0, times).otherwise(0)).alias("known2"),
            F.sum(times * (F.log10(F.col("s.c") + 0.5) - below)).alias("base2"),
            F.sum(F.col("t.coded") * F.col("s.score")).alias("score2"),
        )
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return parts.where("word is null").join(tail, "row", "left").select(
        "doc_id",
        "n_tokens",
        plus("n_known", F.col("known2")).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        plus("base", F.col("base2")).alias("base_score"),
        plus("score", F.col("score2")).alias("score"),
        "n_bytes",
    )


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents scored; four fifths of them, by the id's checksum, are learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    scored = score_documents(docs, ~held_out)
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
