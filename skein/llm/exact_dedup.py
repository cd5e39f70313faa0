"""Exact dedup with a log-structured merge index of digests (DataFrame functions only).

Memtables (rows dealt by id) are flushed as runs that are sorted by digest; compaction merges them, level by level, into one that
has for each digest the row that stays and the number of rows. Its filter, a bitmap of the digests that more than one row has, is
probed by all rows: what it doesn't hold passes without a shuffle, and hits are compared byte for byte with the row that stays.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import NULL_ID, documents, whole_text, written
from skein.llm.keyfilter import key_filter, with_maybe
from skein.session import drop_path, tables_dir, tasks_for


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """Sorted digest runs in a folder. Rows: digest, n (rows that have it), keep (the id that stays)."""

    SCHEMA = "digest binary, n long, keep long, run int"

    def __init__(self, spark, path: str, keep: str = "max", memtables: int = 8, fan: int = 8):
        self.spark, self.path, self.keep, self.memtables, self.fan = spark, path, keep, memtables, fan
        self.runs: list[tuple[str, int]] = []  # folders, and how many runs each has

    def _extreme(self, column: str) -> Column:
        return (F.max if self.keep == "max" else F.min)(column)

    def _flush(self, rows: DataFrame, level: int, runs: int) -> tuple[str, int]:
        """Write rows (run, digest, n, keep) in one job: each run is a folder of files that are sorted by digest and don't overlap."""
        path = f"{self.path}/level{level}-{uuid.uuid4().hex}"
        order = ["run", "digest"]
        rows.repartitionByRange(tasks_for(rows), *order).sortWithinPartitions(*order).write.option("compression", "zstd").partitionBy("run").parquet(path)
        return path, runs

    def add(self, rows: DataFrame) -> None:
        """rows: id, digest. They are dealt to memtables, each of which sums up its own and is flushed as a run of level 0."""
        dealt = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(self.memtables)).cast("int").alias("run"), "digest")
        self.runs.append(self._flush(dealt.agg(F.count(F.lit(1)).alias("n"), self._extreme("id").alias("keep")), 0, self.memtables))

    def _all(self) -> DataFrame:
        """All runs' rows; the runs are numbered through."""
        out, before = [], 0
        for path, runs in self.runs:
            out.append(self.spark.read.schema(self.SCHEMA).parquet(path).withColumn("run", F.col("run") + before))
            before += runs
        return reduce(DataFrame.unionByName, out)

    def compact(self) -> DataFrame:
        """Merge runs, fan of them into one of the next level, until there is one; its rows are returned. Merged runs are deleted."""
        level = 1
        while sum(n for _, n in self.runs) > 1:
            old, count = self.runs, -(-sum(n for _, n in self.runs) // self.fan)
            groups = self._all().groupBy(F.floor(F.col("run") / self.fan).cast("int").alias("run"), "digest")
            self.runs = [self._flush(groups.agg(F.sum("n").alias("n"), self._extreme("keep").alias("keep")), level, count)]
            for path, _ in old:
                drop_path(self.spark, path)
            level += 1
        return self._all().select("digest", "n", "keep")


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    keep: str = "min",
    digest=sha256_digest,
    memtables: int = 8,
    filter_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when their bytes are. Of equal texts the row with the smallest (keep="min") or largest id stays.
    Null texts count as empty. A null id orders before all others, and is returned as null. Rows that repeat an id are rows of
    their own in group_size, and all of them are kept if one is. Other columns are ignored. An empty table gives no rows.
    digest maps a text to a binary key; texts that share a key without being equal are told apart by their bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NULL_ID)).alias("id"), whole_text(text).alias("text")).withColumn("digest", digest(F.col("text")))
    index = DigestIndex(spark, f"{tables_dir(spark)}/digests-{uuid.uuid4().hex}", keep, memtables)
    index.add(rows.select("id", "digest"))
    shared = index.compact().filter("n > 1")
    marked = with_maybe(rows, ["digest"], key_filter(shared, ["digest"], filter_bytes))
    alone = marked.filter(~F.col("_maybe")).select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"), "digest")
    hits = marked.filter("_maybe").drop("_maybe")
    # The bytes of each row that stays; ids that repeat with other texts under one key give one of them, and the others differ from it.
    stays = (
        hits.join(shared.withColumnRenamed("keep", "id"), ["digest", "id"])
        .groupBy("digest")
        .agg(F.max("n").alias("n"), F.max("id").alias("keep"), F.min("text").alias("kept_text"))
    )
    stays = written(stays, "stays")
    compared = written(
        hits.join(stays, "digest", "left").select("id", "digest", "keep", "n", (F.col("text") == F.col("kept_text")).alias("same")),
        "compared",
    )
    same = compared.filter("same is null or same").select("id", F.coalesce("keep", "id").alias("keep"), F.coalesce("n", F.lit(1)).alias("n"), "digest")
    if not compared.filter("not same").isEmpty():
        clash = compared.filter("not same").select("digest").distinct()
        same = same.join(clash, "digest", "left_anti").select("id", "keep", "n", "digest").unionByName(_by_bytes(hits.join(clash, "digest", "left_semi"), index))
    out = alone.unionByName(same)
    null_id = F.lit(NULL_ID)
    return out.select(
        F.nullif("id", null_id).alias("doc_id"),
        F.nullif("keep", null_id).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id") == F.col("keep")).alias("kept"),
        "digest",
    )


def _by_bytes(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """id, keep, n, digest of rows whose digests hold several texts."""
    groups = written(rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), index._extreme("id").alias("keep")), "groups")
    return rows.join(groups, ["digest", "text"]).select("id", "keep", "n", "digest")


def op10(spark, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir), keep="max")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
