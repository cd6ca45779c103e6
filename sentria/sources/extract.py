"""Readers of the text extracts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentria.sources.records import read_records


def read_extract(spark: SparkSession, directory: str, schemas: Mapping[str, T.StructType],
    corrupt: str | None = None, multi_line: bool = False,
) -> dict[str, DataFrame]:
    """Headerless ``$``-separated files ``<name>.txt``, one table per schema.

    Fields are stripped, double quotes quote (doubled inside), backslashes are
    plain, short lines are filled up. A missing text field is an empty string, a
    missing number is null and the text ``NA`` is null. Lines with too many
    fields, or with text in place of a number, keep what fits; with ``corrupt``
    they carry the whole line in a column of that name, else null. ``multi_line``
    allows quoted line breaks; files are read in splits all the same (``records.read_records``).
    """
    tables = {}
    for name, schema in schemas.items():
        full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())]) if corrupt else schema
        options = {
            "columnNameOfCorruptRecord": corrupt or "_corrupt_record",
            "escape": '"',
            "sep": "$",
            "header": "false",
            "quote": '"',
            "mode": "PERMISSIVE",
            "ignoreLeadingWhiteSpace": "true",
            "ignoreTrailingWhiteSpace": "true",
        }
        path = f"{directory.rstrip('/')}/{name}.txt"
        if multi_line:
            parsed = F.from_csv("value", F.lit(full.toDDL()), options)
            raw = read_records(spark, path).select(parsed.alias("r")).select("r.*")
        else:
            raw = spark.read.schema(full).options(**options).csv(path)
        texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
        filled = raw.na.fill("", texts)
        tables[name] = filled.withColumns({c: F.nullif(F.col(c), F.lit("NA")) for c in texts})
    return tables


# The thirteen positional columns of a hierarchy file; the tenth
# and the last are not used.
_HIERARCHY_COLUMNS = (
    "PT_Code", "HLT_Code", "HLGT_Code", "SOC_Code",
    "PT_Term", "HLT_Term", "HLGT_Term", "SOC_Term", "SOC_Abbrev",
    "unused_10", "Primary_PT_SOC", "Primary_SOC_flag", "unused_13",
)
_CODES = {"PT_Code", "HLT_Code", "HLGT_Code", "SOC_Code", "Primary_PT_SOC"}
HIERARCHY_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType() if c in _CODES else T.StringType()) for c in _HIERARCHY_COLUMNS]
)


def read_hierarchy(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Term hierarchy file of one dictionary version; quotes and ``#`` are plain text."""
    raw = spark.read.schema(HIERARCHY_SCHEMA).option("sep", "$").option("quote", "").csv(path)
    raw = raw.na.fill("", [f.name for f in HIERARCHY_SCHEMA.fields if isinstance(f.dataType, T.StringType)])
    return raw.drop("unused_10", "unused_13").withColumn("MEDDRA_VERSION", F.lit(version))
