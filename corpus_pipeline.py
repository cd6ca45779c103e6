"""Corpus pipeline: documents that stay are clean, new, free of benchmark text, and packed.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.common import staged, table
from sentria.llm.decontaminate import contamination
from sentria.llm.jaccard_join import jaccard_components
from sentria.llm.line_dedup import dedup_lines
from sentria.llm.packing import pack
from sentria.llm.toxicity import fit_held_out, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Probability from which a document counts as toxic.
TOXIC = 0.3


def _with(docs: DataFrame) -> DataFrame:
    """The columns of documents, in their order; n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity is ``TOXIC`` or more; the model learns from the labels of all but one fourth."""
    model = fit_held_out(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of several documents stay in the first; documents stay, also where no line is left."""
    return _with(dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by n-gram similarity the document with the smallest doc_id stays.

    Rows without doc_id stay; of rows that share the smallest doc_id of a group all stay.
    """
    groups = jaccard_components(docs)
    beaten = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(beaten, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Learned scores, tokens and packing have no SQL form; the tests compare with brute force.
ORACLE_SQL = None
