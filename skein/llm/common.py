"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import stored

#: The characters that end a word, as a Java character class and as plain characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
#: Stands in for a null document id wherever ids are joined or ordered: such rows come first.
NULL_ID = -(2**63)
_remembered: dict[str, dict] = {}


def release() -> None:
    """Give what this process has freed back to the system: Python's objects, C's memory, Arrow's buffers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def remembered(operator: str) -> dict:
    """What this Python worker remembers from task to task for an operator. What it does for others goes: Spark gives the tasks of all of
    them to the same workers, whose memories would add up."""
    others = [k for k in _remembered if k != operator]
    if others:
        for k in others:
            del _remembered[k]
        release()
    return _remembered.setdefault(operator, {})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's default of ten times as many: rows are whole texts, some of them
    very long, and a batch lies in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def normalised(text: Column) -> Column:
    """Lower case, single spaces; line ends stay. The slow replacement is for texts that need it."""
    low = F.lower(text)
    odd = F.contains(low, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(low, F.lit(c))
    return F.when(odd, F.regexp_replace(low, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(low)


def word_count(norm: Column) -> Column:
    return F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "))) + 1


def length_without(text: Column, characters: str) -> Column:
    """How many characters a text has besides those given."""
    for c in characters:
        text = F.replace(text, F.lit(c))
    return F.length(text)
