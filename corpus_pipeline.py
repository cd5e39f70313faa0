"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows to the shared folder and gives them
to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import NULL_ID, documents, written
from skein.llm.line_dedup import dedup_lines
from skein.llm.line_quality import quality
from skein.llm.mixing import emit, mix
from skein.llm.near_copies import near_copies
from skein.llm.packing import pack
from skein.session import few_files


def _carried(docs: DataFrame) -> DataFrame:
    """The columns that stages look at, and the whole row as one: whatever its names, it comes through."""
    return docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and of the others the lines that too many documents of their source have.

    Null texts are rejected; null sources are one source; rows that repeat stay or go together. An empty table gives no rows.
    """
    found = quality(_carried(docs)).filter("kept")
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return few_files(found.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns]))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, with what is left of its text, null texts as null. An empty table gives no rows."""
    return few_files(dedup_lines(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with 4/5 of their five-word shingles in common the one with the smallest id stays.

    SimHash finds most of the large groups; near_copies completes them. Texts without a word are one group. A null id is the
    smallest; rows that repeat an id that stays all stay. An empty table gives no rows.
    """
    found = near_copies(docs)
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_stays")).distinct()
    return few_files(docs.join(stays, F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("_stays"), "left_semi"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight takes it. Documents without words have the rate of their source; an empty table gives no rows."""
    return few_files(emit(mix(_carried(docs))).select("_row.*"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of what is left: one row per piece. Null texts are empty; rows that repeat are packed each. An empty table gives no rows."""
    return few_files(pack(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Line dedup, near-dedup and packing have no SQL; tests hold each stage against a plain version of it, and run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
