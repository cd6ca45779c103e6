"""Packing: documents into training sequences of fixed length with little padding.

Documents are cut into pieces of at most a sequence; a full piece is a sequence.
The rest is packed by first-fit decreasing inside randomised groups of documents.
A tournament tree over the bins' free space finds the first bin that fits in
logarithmic time. Only lengths and checksums travel, never texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.tokens import END_BYTES, default_vocabulary, encoder

SEQUENCE = 4096
#: Documents per group on average. The last bins of a group carry most of the padding.
GROUP_DOCS = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


class Tournament:
    """Free space of bins; ``first(size)`` is the leftmost bin with at least that much."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.width)

    def first(self, size: int) -> int:
        free, node = self.free, 1
        while node < self.width:
            node *= 2
            if free[node] < size:
                node += 1
        return node - self.width

    def take(self, bin_no: int, size: int) -> int:
        """Put ``size`` into a bin; returns the offset it has there, counted from the capacity's end."""
        free, node = self.free, bin_no + self.width
        left = free[node]
        free[node] = left - size
        node //= 2
        while node:
            free[node] = max(free[2 * node], free[2 * node + 1])
            node //= 2
        return left


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length. Equal lengths are placed in the order given."""
    tree = Tournament(len(lengths), capacity)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        bins[k] = tree.first(lengths[k])
        offsets[k] = capacity - tree.take(bins[k], lengths[k])
    return bins, offsets


def cut(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""
    path = vocabulary or default_vocabulary()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretches = encoder(path).stretches
        for batch in batches:
            doc_ids = batch["doc_id"].tolist()
            for first, part in stretches(batch["text"].tolist()):
                rows = []
                for doc_id, ids in zip(doc_ids[first : first + len(part)], part):
                    ids += END_BYTES
                    for at in range(0, len(ids), 4 * sequence):
                        piece = ids[at : at + 4 * sequence]
                        rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
                frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pieces, PIECES)


def pack(
    docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS
) -> DataFrame:
    """One row per piece: where its ids are in the document and in which sequence they stand.

    A document's ids are those of its text and the end id; null or empty text has
    only the end id. Every id lies in one piece. ``offset`` is gapless from 0 in each
    sequence. Rows that share a doc_id are packed as documents of their own; a row
    without doc_id keeps the null. Other columns are ignored; no rows give no rows.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["group"].iloc[0])
        frame = frame.drop(columns="group").sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        full = (frame["length"] == sequence).to_numpy()
        lengths = frame["length"].to_numpy()
        bins, offsets = first_fit_decreasing(lengths[~full].tolist(), sequence)
        number, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        number[~full], offset[~full] = bins, offsets
        number[full] = max(bins, default=-1) + 1 + np.arange(full.sum())
        return frame.assign(sequence_id=(group << 40) + number, offset=offset)

    grouped = cut(docs, vocabulary, sequence).withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(groups))
    )
    return grouped.groupBy("group").applyInPandas(place, PLACED)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
