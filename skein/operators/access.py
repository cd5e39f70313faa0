"""Random access to sequences through their phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.parse import Reference

#: Positions of a block: both sides of a lookup meet by block, so that it is an equi-join.
BLOCK = 1024


def _blocked(phrases: DataFrame) -> DataFrame:
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("len") - 1) / BLOCK)
    return phrases.withColumn("block", F.explode(F.sequence(first, last)))


def _symbols(text: bytes, pos: Column, n: Column) -> Column:
    return F.substring(F.lit(text), (pos + 1).cast("int"), n.cast("int"))


def access(phrases: DataFrame, positions: DataFrame, id: str, reference: Reference) -> DataFrame:
    """positions: id, p. Adds phrase_idx, pos_in_reference (null in a literal), left_in_phrase and symbol; places outside have no row."""
    at = positions.withColumn("block", F.floor(F.col("p") / BLOCK))
    joined = at.join(_blocked(phrases), [id, "block"]).filter("start <= p and p < start + len")
    place = F.when(F.col("len") > 1, F.col("pos") + F.col("p") - F.col("start"))
    symbol = F.when(F.col("len") > 1, F.conv(F.hex(_symbols(reference.text, place, F.lit(1))), 16, 10).cast("long")).otherwise(F.col("pos"))
    return joined.select(*positions.columns, "phrase_idx", place.alias("pos_in_reference"), (F.col("start") + F.col("len") - F.col("p")).alias("left_in_phrase"), symbol.alias("symbol"))


def spans(phrases: DataFrame, ranges: DataFrame, id: str, reference: Reference) -> DataFrame:
    """ranges: id, p, n. The part of each overlapped phrase: adds phrase_idx, span_start (in the sequence) and span (bytes; a literal is its symbol)."""
    asked = ranges.filter("n > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("p") / BLOCK), F.floor((F.col("p") + F.col("n") - 1) / BLOCK))))
    start, end = F.greatest("p", "start"), F.least(F.col("p") + F.col("n"), F.col("start") + F.col("len"))
    joined = asked.join(_blocked(phrases), [id, "block"]).filter((start < end) & (F.col("block") == F.floor(start / BLOCK)))
    span = F.when(F.col("len") > 1, _symbols(reference.text, F.col("pos") + start - F.col("start"), end - start)).otherwise(F.unhex(F.lpad(F.hex("pos"), 2, "0")))
    return joined.select(*ranges.columns, "phrase_idx", start.alias("span_start"), span.alias("span"))


def extracts(phrases: DataFrame, ranges: DataFrame, id: str, reference: Reference) -> DataFrame:
    """ranges: id, p, n. Adds data: the bytes there, put together from the spans."""
    keys = ranges.columns
    parts = F.transform(F.sort_array(F.collect_list(F.struct("span_start", F.hex("span").alias("span")))), lambda x: x["span"])
    return spans(phrases, ranges, id, reference).groupBy(*keys).agg(F.unhex(F.array_join(parts, "")).alias("data"))


def index_size(symbol_bytes: int, reference_size: int, phrases: int, n: int) -> int:
    """Bytes of the random-access index by its parts: symbols, one pointer a phrase, one bit a position."""
    return symbol_bytes * reference_size + 8 * phrases + (n + 1) // 8
