"""Helpers shared by the operators: tables, staged results, text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.session import new_shared_path

#: White space of all word and line definitions: space, tab, newline, vertical tab, form feed, return.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a result into the shared folder and read it back.

    Several later steps then read files that survive a lost executor, and the
    work above is never repeated.
    """
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Number of tasks for a repartition by value: as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are.

    ``lower`` does the same, and faster, where every character is one byte.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    """Maximal runs of characters outside ``WHITE``; an empty array for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it for every element of an array."""
    return F.transform(F.array(value), use)[0]


def windows_of(values: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` neighbours in an array; empty if it is shorter."""
    hashes = F.transform(values, lambda x: F.xxhash64(x))
    return bind(
        hashes,
        lambda h: F.when(
            F.size(h) >= size,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
