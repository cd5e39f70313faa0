"""Packed 16-mers of a reference: the index over its suffix array, its bucket directory, and parsing that starts from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.bits import KMER, LOW_BITS, bucket, common_bits, low, pack_kmer


def kmers(rows: DataFrame, id: str, text: str, k: int = KMER) -> DataFrame:
    """id, pos, kmer of every place of a cleaned text that has so many symbols left. Cut from bytes: a place in characters is searched for."""
    data = rows.select(id, F.col(text).cast("binary").alias("_t")).filter(F.octet_length("_t") >= k)
    places = data.select(id, "_t", F.explode(F.sequence(F.lit(0), F.octet_length("_t") - k)).alias("pos"))
    return places.select(id, F.col("pos").cast("long").alias("pos"), F.substring("_t", F.col("pos") + 1, F.lit(k)).cast("string").alias("kmer"))


def kmer_index(suffixes: DataFrame, reference: str) -> DataFrame:
    """suffixes: sa_idx, pos of a reference over A, C, G, T. One row per 16-mer: key, bucket, low, sa_start, sa_end (both included)."""
    rows = suffixes.filter(F.col("pos") <= len(reference) - KMER).select("sa_idx", pack_kmer(F.substring(F.lit(reference.encode()), (F.col("pos") + 1).cast("int"), F.lit(KMER)).cast("string")).alias("key"))
    found = rows.groupBy("key").agg(F.min("sa_idx").alias("sa_start"), F.max("sa_idx").alias("sa_end"))
    return found.select("key", bucket(F.col("key")).alias("bucket"), low(F.col("key")).alias("low"), "sa_start", "sa_end")


def bucket_directory(index: DataFrame) -> DataFrame:
    """For each of the 65536 buckets: its entries, the entries before it, and for an empty one the non-empty bucket with the most
    leading bits in common (the left one of a tie; -1 for others). One window over a spine of fixed size."""
    spine = index.sparkSession.range(1 << LOW_BITS).select(F.col("id").alias("bucket"))
    counts = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("entries"))
    rows = spine.join(counts, "bucket", "left").withColumn("entries", F.coalesce("entries", F.lit(0).cast("long")))
    order, back = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.orderBy("bucket"), Window.orderBy(F.desc("bucket"))))
    full = F.when(F.col("entries") > 0, F.col("bucket"))
    left = F.last(full, ignorenulls=True).over(order)
    right = F.last(full, ignorenulls=True).over(back)
    before = F.coalesce(F.sum("entries").over(order), F.lit(0).cast("long"))
    rows = rows.withColumns({"first_entry": before, "left": left, "right": right})
    b = F.col("bucket")
    nearest = F.when(F.col("left").isNull(), F.col("right")).when(F.col("right").isNull(), F.col("left")).when(common_bits(b, F.col("left")) >= common_bits(b, F.col("right")), F.col("left")).otherwise(F.col("right"))
    return rows.select("bucket", "entries", "first_entry", F.when(F.col("entries") == 0, nearest).otherwise(F.lit(-1).cast("long")).alias("nearest"))


def seeded(phrases: DataFrame, texts: DataFrame, index: DataFrame, id: str) -> DataFrame:
    """What the index says at each phrase start with 16 symbols left. texts: id, text (cleaned). Adds key, sa_start, sa_end (null: no such 16-mer)."""
    starts = phrases.join(texts.select(id, F.col("text").cast("binary").alias("data")), id).filter(F.col("start") + KMER <= F.octet_length("data"))
    keyed = starts.withColumn("key", pack_kmer(F.substring("data", (F.col("start") + 1).cast("int"), F.lit(KMER)).cast("string"))).drop("data")
    return keyed.join(index.select("key", "sa_start", "sa_end"), "key", "left")


def seed_stats(seeds: DataFrame, index: DataFrame, id: str) -> DataFrame:
    """By sequence: lookups that hit one suffix, several, or none; the index's entries and size in bytes are those of the whole."""
    entries = index.agg(F.count(F.lit(1)).alias("entries"))
    one = F.col("sa_start").isNotNull() & (F.col("sa_start") == F.col("sa_end"))
    several = F.col("sa_start") < F.col("sa_end")
    found = seeds.groupBy(id).agg(F.count_if(one).alias("singleton_hits"), F.count_if(several).alias("range_hits"), F.count_if(F.col("sa_start").isNull()).alias("misses"))
    hits = F.col("singleton_hits") + F.col("range_hits")
    return found.crossJoin(entries).select(  # by one row
        id, hits.alias("hits"), "misses", "singleton_hits", "range_hits", (hits / (hits + F.col("misses"))).alias("hit_rate"), "entries", (F.lit(4 * 65537) + 6 * F.col("entries")).alias("approx_bytes")
    )


def fast_factors(seeds: DataFrame, directory: DataFrame, index: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The short factor that an empty bucket gives instead of a search: half the leading bits it shares with the nearest one, at
    that one's first suffix. Adds fast_pos, fast_len (null where the bucket isn't empty)."""
    first = index.groupBy(F.col("bucket").alias("nearest")).agg(F.min("sa_start").alias("sa_idx"))
    empty = directory.filter("entries = 0").join(first, "nearest").join(suffixes, "sa_idx").select("bucket", "nearest", F.col("pos").alias("fast_pos"))
    empty = empty.withColumn("fast_len", F.floor(common_bits(F.col("bucket"), F.col("nearest")) / 2)).drop("nearest")
    return seeds.withColumn("bucket", bucket(F.col("key"))).join(empty, "bucket", "left")
