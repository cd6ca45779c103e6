"""Token-id files: canonical length-limited Huffman codes from global counts.

Layout of a written folder (``write_tokens``):

``codes``   (id, bits): the length of each id's code; canonical order gives the codes.
``blocks``  one row per block: file_no, block_no, first_token (in its file), n_tokens,
            payload (big-endian bit stream), checkpoints (little-endian unsigned 64-bit:
            the bit offset of every ``STRIDE``-th token), and the documents in it:
            doc_ids, doc_firsts (ids of the document before this block) and doc_lengths.
            Files and blocks follow ascending doc_id; a long document may run on in
            later blocks. Every block is decoded on its own, and from any checkpoint.

The payloads lie in Parquet columns, so that Spark reads and writes them in any store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.common import staged, tasks
from sentria.llm.tokens import END_BYTES, default_vocabulary, encoder
from sentria.session import new_shared_path

#: Longest code. The decoding table has two to this power entries; 2 ** MAX_BITS ids fit.
MAX_BITS = 18
#: Tokens between two checkpoints, and tokens in a block at most.
STRIDE = 256
BLOCK = 1 << 18
BLOCKS = (
    "file_no int, block_no int, first_token long, n_tokens long, payload binary, checkpoints binary, "
    "doc_ids array<long>, doc_firsts array<long>, doc_lengths array<long>"
)


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``max_bits`` for positive counts (package-merge).

    One symbol gets one bit; none give none.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError("more symbols than codes of that length")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    # A level holds the symbols and the pairs of the level before, by weight.
    levels = []
    packages = np.zeros(0)
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by)
        ranked = merged[by]
        even = len(ranked) // 2 * 2
        packages = ranked[0:even:2] + ranked[1:even:2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for by in reversed(levels):
        chosen = by[:take]
        symbols = chosen[chosen < n]
        lengths[symbols] += 1
        take = 2 * (len(chosen) - len(symbols))
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: by length, then id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = np.asarray(ids, np.int64)[order], np.asarray(lengths, np.int64)[order]
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.width = int(lengths.max()) if len(ids) else 1
        spans = np.left_shift(1, self.width - lengths)
        firsts = np.cumsum(spans) - spans
        self.code[ids] = (firsts >> (self.width - lengths)).astype(np.uint64)
        self.bits[ids] = lengths
        self.symbol_at = np.zeros(1 << self.width, np.uint32)
        self.bits_at = np.ones(1 << self.width, np.uint8)
        used = int(spans.sum())
        self.symbol_at[:used] = np.repeat(ids, spans)
        self.bits_at[:used] = np.repeat(lengths, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(payload, checkpoints) of a block."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        total = int(ends[-1]) if len(ids) else 0
        word, inside = at >> 5, at & 31
        window = self.code[ids] << (64 - inside - bits).astype(np.uint64)
        words = np.zeros(total // 32 + 2)
        # Codes share no bit, so sums of their 32-bit halves are exact in double precision.
        words += np.bincount(word, (window >> np.uint64(32)).astype(np.float64), len(words))
        words[1:] += np.bincount(word, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words) - 1)
        payload = words.astype(np.uint64).astype(">u4").tobytes()[: -(-total // 8)]
        return payload, at[::STRIDE].astype("<u8").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n_tokens: int) -> np.ndarray:
        """All ids of a block; the stretches between checkpoints are decoded side by side."""
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        # The 32 bits from each byte on; with MAX_BITS + 7 <= 32 they hold the next code.
        view = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        out = np.zeros((STRIDE, len(at)), np.uint32)
        shift, mask = 32 - self.width, (1 << self.width) - 1
        last = len(payload) * 8
        for k in range(STRIDE):
            place = np.minimum(at, last)
            peek = (view[place >> 3] >> (shift - (place & 7)).astype(np.uint32)) & mask
            out[k] = self.symbol_at[peek]
            at += self.bits_at[peek]
        return out.T.reshape(-1)[:n_tokens]


def token_rows(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, packed: ids with the end id, 32 bits each, compressed."""
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            doc_ids = batch["doc_id"].astype("Int64")
            for first, part in own.stretches(batch["text"].tolist()):
                ids = [i + END_BYTES for i in part]
                yield pd.DataFrame(
                    {
                        "doc_id": doc_ids.iloc[first : first + len(ids)].array,
                        "n_tokens": [len(i) // 4 for i in ids],
                        "packed": [press.compress(_narrow(i)) for i in ids],
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        encode, "doc_id long, n_tokens long, packed binary"
    )


def _narrow(ids: bytes) -> bytes:
    """A leading byte and the ids in 16 bits where all fit, else in 32."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else b"\x04" + ids


def _widen(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def id_counts(rows: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs; counted inside tasks before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for packed in batch["packed"]:
                own = np.bincount(_widen(packed))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own
                else:
                    total[: len(own)] += own
        (ids,) = np.nonzero(total)
        yield pd.DataFrame({"id": ids, "n": total[ids]})

    return rows.select("packed").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, vocabulary: str | None = None, path: str | None = None) -> str:
    """Encode all documents into a new folder of the format above; returns the folder.

    Null or empty text has only the end id. Rows without doc_id come first; rows
    that share a doc_id follow each other, shorter ones first. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or new_shared_path(spark, "tokens")
    rows = staged(token_rows(docs, vocabulary), "token-rows")
    # At most one row per id of the vocabulary.
    counts = id_counts(rows).orderBy("id").toPandas()
    ids, lengths = counts["id"].to_numpy(), code_lengths(counts["n"].to_numpy())
    spark.createDataFrame(pd.DataFrame({"id": ids, "bits": lengths}), "id long, bits long").write.parquet(
        f"{path}/codes"
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        file_no = TaskContext.get().partitionId()
        book = Codebook(ids, lengths)
        state = {"no": 0, "first": 0}
        held: list[np.ndarray] = []
        docs_in: list[tuple[int, int, int]] = []
        size = 0

        def close() -> pd.DataFrame:
            nonlocal held, docs_in, size
            payload, checkpoints = book.encode(np.concatenate(held))
            doc_ids, firsts, own = map(list, zip(*docs_in))
            row = (file_no, state["no"], state["first"], size, payload, checkpoints, doc_ids, firsts, own)
            state["no"] += 1
            state["first"] += size
            held, docs_in, size = [], [], 0
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, packed in zip(batch["doc_id"], batch["packed"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                all_ids, at = _widen(packed), 0
                while at < len(all_ids):
                    part = all_ids[at : at + BLOCK - size]
                    held.append(part)
                    docs_in.append((doc_id, at, len(part)))
                    at, size = at + len(part), size + len(part)
                    if size == BLOCK:
                        yield close()
        if size:
            yield close()

    ordered = rows.repartitionByRange(tasks(spark), "doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", "packed")
    ordered.select("doc_id", "packed").mapInPandas(encode, BLOCKS).write.parquet(f"{path}/blocks")
    return path


def _shift_crc(crc: int, n_bytes: int) -> int:
    """crc32 register after ``n_bytes`` zero bytes (squaring of the one-bit step)."""

    def times(matrix: list[int], v: int) -> int:
        out = 0
        for k in range(32):
            if v >> k & 1:
                out ^= matrix[k]
        return out

    step = [0xEDB88320] + [1 << k for k in range(31)]
    n = 8 * n_bytes
    while n:
        if n & 1:
            crc = times(step, crc)
        step = [times(step, row) for row in step]
        n >>= 1
    return crc


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of a byte string from (crc32, length in bytes) of its consecutive parts."""
    out = 0
    for crc, n in parts:
        out = _shift_crc(out, n) ^ crc
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    codes = spark.read.parquet(f"{path}/codes").orderBy("id").toPandas()
    ids, lengths = codes["id"].to_numpy(), codes["bits"].to_numpy()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row per file.
    sizes = blocks.groupBy("file_no").agg(F.sum("n_tokens").alias("n")).orderBy("file_no").collect()
    before, total = {}, 0
    for file_no, n in sizes:
        before[file_no], total = total, total + n

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Codebook(ids, lengths)
        for batch in batches:
            for b in batch.itertuples():
                tokens = book.decode(b.payload, b.checkpoints, b.n_tokens).astype("<u4")
                own = np.asarray(b.doc_lengths, np.int64)
                at = np.cumsum(own) - own
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(list(b.doc_ids), "Int64"),
                        "start": before[b.file_no] + b.first_token + at - np.asarray(b.doc_firsts, np.int64),
                        "first": np.asarray(b.doc_firsts, np.int64),
                        "length": own,
                        "crc": [zlib.crc32(tokens[a : a + n].tobytes()) for a, n in zip(at, own)],
                    }
                )

    # A document's parts have the same start; it is unique even where doc_id is not.
    parts = blocks.mapInPandas(decode, "doc_id long, start long, first long, length long, crc long")

    @F.pandas_udf("long")
    def whole(runs: pd.Series) -> pd.Series:
        return runs.map(lambda r: r[0]["crc"] if len(r) == 1 else joined_crc([(p["crc"], 4 * p["length"]) for p in r]))

    grouped = parts.groupBy("doc_id", "start").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("first", "length", "crc"))).alias("runs")
    )
    return grouped.select("doc_id", "start", "n_tokens", whole("runs").alias("ids_crc32"))


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents encoded, written as files and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_tokens(spark, write_tokens(docs))
