"""Records of delimited text whose quoted fields may hold line breaks, read in splits.

Where a split starts, it cannot be seen whether a quoted field is open. So a first pass
finds for every split, from its lines with quotes alone, how it ends for either start;
chained from the start of each file, that fixes every start. A second pass cuts
each split into records on its own. Records that run over the end of a split are put
together from their parts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENDS = "file long, block long, open0 boolean, records0 long, open1 boolean, records1 long"
_PARTS = "file long, record long, block long, line long, value string"


def ends_open(line: str, is_open: bool, sep: str, quote: str) -> bool:
    """Whether a quoted field is open behind a line, given whether one is open before it.

    A field is quoted if its first character but blanks is a quote; inside, a doubled
    quote stands for one. Quotes in other places are plain text.
    """
    at, opening = 0, re.compile(rf"[ \t]*{re.escape(quote)}")
    while True:
        if is_open:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            is_open = False
        elif start := opening.match(line, at):
            is_open, at = True, start.end()
            continue
        at = line.find(sep, at) + 1
        if at == 0:
            return False


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, int], bool, list[str]]]:
    """The lines of a task batch by batch and split by split; the flag tells where a split starts."""
    last = None
    for batch in batches:
        starts = (batch["file"] != batch["file"].shift()) | (batch["block"] != batch["block"].shift())
        for _, rows in batch.groupby(starts.cumsum(), sort=False):
            key = (int(rows["file"].iloc[0]), int(rows["block"].iloc[0]))
            yield key, key != last, rows["value"].tolist()
            last = key


def _split_ends(lines: DataFrame, sep: str, quote: str) -> DataFrame:
    """Per split and start: whether a field is open at the end, and how many records of several lines start in it."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, found = None, [], []
        for own, first, values in _blocks(batches):
            if first:
                if key:
                    found.append((*key, *now[0], *now[1]))
                key, now = own, [(False, 0), (True, 0)]
            for line in values:
                for k, (was, n) in enumerate(now):
                    after = ends_open(line, was, sep, quote)
                    now[k] = (after, n + (after and not was))
        if key:
            found.append((*key, *now[0], *now[1]))
        yield pd.DataFrame(found, columns=[c.split()[0] for c in _ENDS.split(", ")])

    return lines.filter(F.contains("value", F.lit(quote))).mapInPandas(ends, _ENDS)


class _Starts:
    """How each split starts: from the ends of the splits before it in the file."""

    def __init__(self, ends: list):
        self.after: dict[int, list[tuple[int, bool, int]]] = defaultdict(list)
        for r in sorted(ends, key=lambda r: (r.file, r.block)):
            was, n = self(r.file, r.block)
            now, more = (r.open1, r.records1) if was else (r.open0, r.records0)
            self.after[r.file].append((r.block, now, n + more))

    def crossings(self) -> list[tuple[int, int, int]]:
        """(file, first split, last split) of the stretches in which a record runs from split to split."""
        out = []
        for file, known in self.after.items():
            ends = [b for b, _, _ in known[1:]] + [1 << 62]
            out += [(file, block, end) for (block, is_open, _), end in zip(known, ends) if is_open]
        return out

    def __call__(self, file: int, block: int) -> tuple[bool, int]:
        """(a field is open, number of records of several lines that started before) at a split."""
        known = self.after.get(file, [])
        at = bisect_left(known, (block,))
        return known[at - 1][1:] if at else (False, 0)


def read_records(spark: SparkSession, path: str, sep: str = "$", quote: str = '"') -> DataFrame:
    """One row ``value`` per record of the text files of a path; lines inside a quoted field are joined by line feeds.

    Lines end with a line feed, with or without a carriage return before it. Blank lines
    between records are no records. A quote that is never closed makes the rest of its
    file one record. Files of any size are read in splits; the driver sees one row per
    split that has quotes. The path is read twice (a third time for splits within a
    record); it must not change in between.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", r"\r\z", "").alias("value"),
    )
    starts = _Starts(_split_ends(lines, sep, quote).collect())
    if not starts.after:
        return lines.filter(F.trim("value") != "").select("value")

    def cut(only_parts: bool):
        def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part: list[str] = []
            number = line = 0
            is_open = carried = False
            key = (0, 0)
            columns = [c.split()[0] for c in _PARTS.split(", ")]

            def left() -> pd.DataFrame:
                """Lines of the record that reaches over the split's start or end."""
                return pd.DataFrame([(key[0], number, key[1], line - len(part) + k, v) for k, v in enumerate(part)], columns=columns)

            for own, first, values in _blocks(batches):
                if first:
                    if part and only_parts:
                        yield left()
                    key, part, line = own, [], 0
                    is_open, number = starts(*own)
                    carried = is_open
                whole: list[str] = []
                for value in values:
                    was, line = is_open, line + 1
                    if quote in value:
                        is_open = ends_open(value, was, sep, quote)
                    if not was and not is_open:
                        whole.append(value)
                        continue
                    if not was:
                        number += 1
                    if only_parts or not carried:
                        part.append(value)
                    if not is_open:
                        if not carried:
                            whole.append("\n".join(part))
                        elif only_parts:
                            yield left()
                        part, carried = [], False
                if not only_parts:
                    yield pd.DataFrame({"value": whole}, dtype=object)
            if part and only_parts:
                yield left()

        return records

    complete = lines.mapInPandas(cut(False), "value string")
    crossing = starts.crossings()
    if not crossing:
        return complete.filter(F.trim("value") != "")
    some = F.broadcast(spark.createDataFrame(crossing, "of long, first long, last long"))
    within = (F.col("file") == F.col("of")) & F.col("block").between(F.col("first"), F.col("last"))
    parts = lines.join(some, within, "left_semi").mapInPandas(cut(True), _PARTS)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "value"))), lambda p: p["value"])
    joined = parts.groupBy("file", "record").agg(F.array_join(pieces, "\n").alias("value"))
    return complete.unionByName(joined.select("value")).filter(F.trim("value") != "")
