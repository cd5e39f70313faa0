"""Suffix arrays: of a reference that a worker holds, and of one that is spread over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import checkpointed, with_ordinal

#: Symbols in the first key: nine bits each, so that past the end comes before any byte.
FIRST = 7


def first_keys(text: np.ndarray) -> np.ndarray:
    """For each position the next seven symbols as one number."""
    n = len(text)
    padded = np.concatenate((text.astype(np.int64) + 1, np.zeros(FIRST, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(FIRST):
        key = key << 9 | padded[k : k + n]
    return key


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of bytes by prefix doubling; a suffix comes before those that it begins."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    key = first_keys(text)
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    slots, sorted_key, depth = np.arange(n), key[order], FIRST
    while True:
        # slots: the places of order that are being ranked, group by group; a rank is the first place of its group
        new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(new)))
        rank[order[slots]] = np.repeat(slots[first], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return order
        at = order[slots]
        ahead = at + depth
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        sorted_key = rank[at] * (n + 1) + second
        by = np.argsort(sorted_key, kind="stable")  # groups are in order, so that little is left to move
        order[slots], sorted_key = at[by], sorted_key[by]
        depth *= 2


def suffix_array_table(symbols: DataFrame) -> DataFrame:
    """symbols: pos (from 0, dense), symbol. Rows sa_idx, pos. Each round joins ranks with those further on and sorts by both, in ranges."""
    n = symbols.count()
    ranks = checkpointed(symbols.select("pos", (F.col("symbol").cast("long") + 1).alias("rank")))
    step = 1
    while True:
        ahead = ranks.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("second"))
        pairs = ranks.join(ahead, "pos", "left").withColumn("second", F.coalesce("second", F.lit(0).cast("long")))
        placed = with_ordinal(pairs, [F.col("rank"), F.col("second"), F.col("pos")], "place")
        least = Window.partitionBy("rank", "second")
        ranks = checkpointed(placed.select("pos", (F.min("place").over(least) + 1).alias("rank")))
        if ranks.agg(F.count_distinct("rank")).first()[0] == n:
            return ranks.select((F.col("rank") - 1).alias("sa_idx"), "pos")
        step *= 2
