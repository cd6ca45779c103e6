"""Dated snapshots of tables, and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sentria.functions.cleaning import pad_id


def snapshot_path(root: str, table: str, date: str) -> str:
    return f"{root.rstrip('/')}/{table}/extract_date={date}"


def open_snapshot(spark: SparkSession, root: str, table: str, date: str) -> DataFrame:
    """A table as of an extract date (``yyyymmdd``)."""
    return spark.read.parquet(snapshot_path(root, table, date))


def write_snapshot(
    t: DataFrame, root: str, table: str, date: str, partition_by: Sequence[str] = ()
) -> str:
    """Write a new dated snapshot; fails if it exists.

    ``partition_by="quarter"`` lays a fact table out for cohort cuts, which then
    prune directories instead of reading rows.
    """
    path = snapshot_path(root, table, date)
    writer = t.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    writer.parquet(path)
    return path


def write_stats(t: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Persist a statistic table."""
    t.write.mode(mode).parquet(path)


# Identifier columns that exports pad.
PADDED_IDS = ("REPORT_ID", "REPORT_NO")


def export_frame(t: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The chosen columns of an export, ids padded."""
    padded = t.withColumns({c: pad_id(c) for c in PADDED_IDS if c in columns})
    return padded.select(*columns)


def _write_csv(t: DataFrame, path: str) -> None:
    # Writers strip leading white space by default, which would cut the TAB of padded ids.
    (
        t.write.mode("errorifexists")
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("nullValue", "NA")
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export_csv(t: DataFrame, columns: Sequence[str], path: str) -> None:
    """CSV of the chosen report, drug or reaction columns: UTF-8, header, no row names."""
    _write_csv(export_frame(t, columns), path)


def export_signals(t: DataFrame, path: str) -> None:
    """CSV of a filtered signal table."""
    _write_csv(t, path)
