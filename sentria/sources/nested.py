"""Nested report documents: schema, reader, and a builder from flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIOUS_FLAGS = (
    "death",
    "lifethreatening",
    "hospitalization",
    "disabling",
    "congenitalanomali",
    "other",
)

_NAMES = T.ArrayType(T.StringType())
NESTED_SCHEMA = T.StructType(
    [
        T.StructField("receivedate", T.DateType()),
        T.StructField("occurcountry", T.StringType()),
        T.StructField("serious", T.IntegerType()),
        T.StructField(
            "seriousness", T.StructType([T.StructField(f, T.IntegerType()) for f in SERIOUS_FLAGS])
        ),
        T.StructField("primarysource", T.StructType([T.StructField("qualification", T.IntegerType())])),
        T.StructField(
            "patient",
            T.StructType(
                [
                    T.StructField("patientsex", T.IntegerType()),
                    T.StructField("patientonsetage", T.DoubleType()),
                    T.StructField("patientonsetageunit", T.StringType()),
                    T.StructField(
                        "drug",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("drugindication", T.StringType()),
                                    T.StructField(
                                        "openfda",
                                        T.StructType(
                                            [
                                                T.StructField("generic_name", _NAMES),
                                                T.StructField("brand_name", _NAMES),
                                                T.StructField("pharm_class_epc", _NAMES),
                                            ]
                                        ),
                                    ),
                                ]
                            )
                        ),
                    ),
                    T.StructField(
                        "reaction",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("reactionmeddrapt", T.StringType()),
                                    T.StructField("reactionoutcome", T.IntegerType()),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
    ]
)


def read_nested_reports(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """Report documents as JSON lines or parquet, with the fixed schema (nothing is inferred)."""
    return spark.read.schema(NESTED_SCHEMA).format(file_format).load(path)


def nest_reports(reports: DataFrame, drugs: DataFrame, reactions: DataFrame) -> DataFrame:
    """Documents from flat tables: one row per report with its drug and reaction arrays.

    A document is a single row by definition, so its arrays are as long as the
    report has rows; summaries over nested data explode them again.
    """
    entry = F.struct(
        "drugindication",
        F.struct(
            F.array("generic_name").alias("generic_name"),
            F.array("brand_name").alias("brand_name"),
            F.array("pharm_class_epc").alias("pharm_class_epc"),
        ).alias("openfda"),
    )
    drug = drugs.groupBy("REPORT_ID").agg(F.collect_list(entry).alias("drug"))
    reaction = reactions.groupBy("REPORT_ID").agg(
        F.collect_list(F.struct("reactionmeddrapt", "reactionoutcome")).alias("reaction")
    )
    return (
        reports.join(drug, "REPORT_ID", "left")
        .join(reaction, "REPORT_ID", "left")
        .select(
            "receivedate",
            "occurcountry",
            "serious",
            F.struct(*SERIOUS_FLAGS).alias("seriousness"),
            F.struct("qualification").alias("primarysource"),
            F.struct(
                "patientsex", "patientonsetage", "patientonsetageunit", "drug", "reaction"
            ).alias("patient"),
        )
    )
