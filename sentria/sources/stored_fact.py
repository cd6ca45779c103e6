"""Report tables laid out for their readers: by quarter in folders, by report in buckets.

Counts, distinct reports, joins and semi-joins on the report then need no exchange, and
a cohort cut by quarter reads its folders only. Two tables with the same number of
buckets join report by report as they lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(path: str) -> str:
    """Name of the table at a path in the session's catalog."""
    return f"stored_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:24]}"


def write_stored(t: DataFrame, path: str, buckets: int, report: str = "REPORT_ID", by: str | None = "quarter") -> DataFrame:
    """Write a table into a new folder and open it.

    Rows move once, so each bucket of a quarter is one file, sorted by report. Choose
    ``buckets`` so that one of all quarters fits a task, and the same for tables that
    are joined. Rows without a report share a bucket.
    """
    spark = t.sparkSession
    writer = t.repartition(buckets, report).write.format("parquet").mode("errorifexists").option("path", path)
    if by:
        writer = writer.partitionBy(by)
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    writer.bucketBy(buckets, report).sortBy(report).saveAsTable(_name(path))
    return spark.table(_name(path))


def open_stored(
    spark: SparkSession, path: str, buckets: int, report: str = "REPORT_ID", by: str | None = "quarter"
) -> DataFrame:
    """Open a folder that ``write_stored`` has written, in this or in another session."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        schema = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        parts = f"PARTITIONED BY (`{by}`)" if by else ""
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet {parts} "
            f"CLUSTERED BY (`{report}`) SORTED BY (`{report}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        if by:
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def distinct_reports(t: DataFrame, columns: Sequence[str], report: str = "REPORT_ID") -> DataFrame:
    """Distinct reports per combination of values, nulls left out: one exchange, above the counts of each bucket."""
    rows = t.select(report, *columns).na.drop().distinct()
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).cast("long").alias("count"))
