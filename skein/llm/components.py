"""Connected components of a table of links, without links or components on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import checkpointed


def spanning_links(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each node but the smallest of its component: the node and that smallest one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent if root(x) != x]


def within_partitions(links: DataFrame) -> DataFrame:
    """The same components from fewer links: each batch's links become stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spanning_links(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step of the star algorithm. Large: a node's larger neighbours go to the smallest near it; small: its smaller ones and itself do.

    The smallest neighbour is a sum over any number of rows, and a table of its own before it is joined, so that Spark can split
    the links of a node that very many have.
    """
    if large:
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpointed(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    joined = links.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root: the smallest node of the component, for each node that has a link to another."""
    pair = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    now = checkpointed(within_partitions(links.select(*pair).filter("a != b").distinct()).distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark
        now = checkpointed(_stars(now, large=True))
        now = checkpointed(_stars(now.select(*pair), large=False))
