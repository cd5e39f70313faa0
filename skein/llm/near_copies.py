"""SimHash near-dedup completed to all links of a similarity.

Fingerprints of few differing bits are near copies almost always, but not the other way round: of texts with 4/5 of their five-word
shingles in common most differ in more bits than a covering code can bridge. So what SimHash finds is verified, and a prefix join
finds the rest exactly. Of two texts with a similarity of at least 4/5, of which one has n shingles, at least ceil(4n/5) are shared:
so the first n - ceil(4n/5) + 1 of either, in any order that is the same for all texts, have one in common. Texts meet there, and
are compared in full. Common shingles come last in that order, so that few texts meet without being alike; and what is found among
neighbours makes groups first, so that a large group of near copies isn't compared in all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import NULL_ID, SPACES, release, remembered, small_batches, whole_text, written
from skein.llm.components import components
from skein.llm.keyfilter import KeyBits, key_bits, key_filter, with_maybe
from skein.llm.simhash import fingerprints, links
from skein.session import drop_table, free_shuffles

#: The words of a shingle and the least similarity, SHARED / ALL.
SHINGLE, SHARED, ALL = 5, 4, 5
#: Rows of complete keys that are compared at once.
BLOCK = 100_000
#: Shingles that OFTEN of NEXT texts that follow one another have, or MANY of all texts in their prefixes, are common: they come last
#: in the order. It decides what is compared where, not what is found. ROUNDS: how often prefixes are made at most.
OFTEN, NEXT, MANY, ROUNDS = 4, 1024, 128, 2
#: No further round if the pairs that meet are so many times the texts at most.
PAIRS = 50
#: Words that a worker remembers the hash of, and texts that it remembers the shingles of.
REMEMBERED, HELD = 1_000_000, 1000
#: Buckets in which a text's shingles are counted.
BUCKETS = 128


class Shingles(dict):
    """Texts to the sorted hashes of their shingles, each once; a shorter text is one shingle. Words are in lower case. Holds words' hashes."""

    def __init__(self):
        super().__init__()
        remembered("near-copies")  # of packing's words, say, nothing is left beside these

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word).to_bytes(8, "little")
        return found

    def of(self, text: bytes) -> np.ndarray:
        words = np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), "<u8")
        size = min(SHINGLE, len(words))
        if not size:
            return np.zeros(0, np.int64)
        n, found = len(words) - size + 1, words[: len(words) - size + 1]
        for k in range(1, size):
            found = (found ^ found >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        return np.unique((found ^ found >> np.uint64(32)).view(np.int64))


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return ALL * both >= SHARED * (len(one) + len(two) - both)


def sketch(keys: np.ndarray) -> bytes:
    """How many of a text's shingles fall into each bucket, in a byte each; nothing if one has too many for that."""
    counts = np.bincount(keys & (BUCKETS - 1), minlength=BUCKETS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_similar(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """Whether texts of these sketches may be similar: they share in each bucket at most what the one with fewer there has."""
    out = np.ones(len(one), bool)
    known = [k for k, (a, b) in enumerate(zip(one, two, strict=True)) if a and b]
    a, b = (np.frombuffer(b"".join(x[k] for k in known), np.uint8).reshape(-1, BUCKETS) for x in (one, two))
    both = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    out[known] = ALL * both >= SHARED * (a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64) - both)
    return out


def prefixes(texts: DataFrame, common: KeyBits | None) -> DataFrame:
    """texts: node, text (binary). Rows node, n (the text's shingles), keys: its prefix, in the order in which common shingles
    come last, and sketch; and a row without a node for keys that are found to be common besides."""
    held = texts.sparkSession.sparkContext.broadcast(common)  # a bitmap of at most keyfilter.FILTER_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, shingles, last, recent = set(), Shingles(), held.value, []
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                nodes, sizes, keys, sketches = [], [], [], []
                for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if node in seen:
                        continue
                    seen.add(node)
                    found = shingles.of(text)
                    if last is not None and len(found):
                        late = last.may_have(found)
                        found = np.concatenate((found[~late], found[late]))
                    nodes.append(node)
                    sizes.append(len(found))
                    sketches.append(sketch(found))
                    keys.append(found[: len(found) - (-(-SHARED * len(found) // ALL)) + 1] if len(found) else found)
                recent += keys
                if len(recent) >= NEXT:
                    key, n = np.unique(np.concatenate(recent), return_counts=True)
                    nodes, sizes, keys, sketches, recent = [*nodes, None], [*sizes, 0], [*keys, key[n >= OFTEN]], [*sketches, None], []
                offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(sketches, pa.binary())], names=["node", "n", "keys", "sketch"])
        shingles.clear()
        release()  # the worker waits for its next task beside the JVM, which needs the memory

    return texts.select("node", "text").mapInArrow(run, "node long, n long, keys array<long>, sketch binary")


def met(key: np.ndarray, n: np.ndarray, place: np.ndarray, node: np.ndarray, root: np.ndarray, every: bool) -> np.ndarray:
    """Pairs of nodes at a key that may be similar; rows are sorted by key and n. Not every: only a row's neighbour and the key's first.

    A pair passes at the first key that it shares: what follows there must suffice.
    """
    out = []

    def pairs(at: np.ndarray, other: np.ndarray) -> None:
        rest = np.minimum(n[at] - place[at], n[other] - place[other])
        near = (node[at] != node[other]) & (root[at] != root[other]) & ((ALL + SHARED) * rest >= SHARED * (n[at] + n[other]))
        out.append(np.stack([np.minimum(node[at], node[other])[near], np.maximum(node[at], node[other])[near]], axis=1))

    at, shift = np.arange(len(key)), 1
    while len(at) and (every or shift == 1):
        at = at[at + shift < len(key)]
        at = at[(key[at] == key[at + shift]) & (ALL * n[at] >= SHARED * n[at + shift])]
        pairs(at, at + shift)
        shift += 1
    if not every and len(key):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        pairs(np.repeat(starts, np.diff(np.append(starts, len(key)))), np.arange(len(key)))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def rooted(table: DataFrame, groups: DataFrame) -> DataFrame:
    """table with root: that of the node's group, or the node itself. Only nodes that are in a group are shuffled."""
    marked = with_maybe(table, ["node"], key_filter(groups, ["node"]))
    some = marked.filter("_maybe").drop("_maybe").join(groups.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return some.select(*table.columns, "root").unionByName(marked.filter("not _maybe").drop("_maybe").withColumn("root", F.col("node")))


def shared_keys(table: DataFrame) -> DataFrame:
    """key, many of the keys that texts of different roots have in their prefixes. table: node, keys, root."""
    keys = table.select("root", F.explode("keys").alias("key"))
    return keys.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("many")).filter("a != b").select("key", "many")


def candidates(table: DataFrame, shared: DataFrame, every: bool) -> DataFrame:
    """a, b: nodes of different roots that meet at a key. Not every: only neighbours. table: node, n, keys, root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(last: bool) -> pa.RecordBatch:
            rows = [np.concatenate([h[k] for h in held]) for k in range(5)]
            cut = len(rows[0]) if last else int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on
            held[:] = [[r[cut:] for r in rows]]
            found = met(*(r[:cut] for r in rows), every)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        size = 0
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
            size += batch.num_rows
            if size >= BLOCK:
                yield flush(False)
                size = 0
        if held:
            yield flush(True)

    rows = table.select("n", "node", "root", F.posexplode("keys").alias("place", "key"))
    rows = with_maybe(rows, ["key"], key_filter(shared, ["key"])).filter("_maybe")
    rows = rows.select("key", "n", F.col("place").cast("long").alias("place"), "node", "root")
    return rows.repartition("key").distinct().sortWithinPartitions("key", "n", "node").mapInArrow(run, "a long, b long").distinct()


def of_pairs(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with a column of table (node) for each of both, as column_a and column_b."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    some = with_maybe(table.select("node", column), ["node"], key_filter(nodes, ["node"])).filter("_maybe").drop("_maybe").dropDuplicates(["node"])
    one, two = (some.select(F.col("node").alias(c), F.col(column).alias(f"{column}_{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", f"{column}_a", f"{column}_b")


def likely(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The pairs whose sketches don't rule it out that they are similar. table: node, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(may_be_similar(batch.column(2).to_pylist(), batch.column(3).to_pylist()), pa.bool_()))

    return of_pairs(pairs, table, "sketch").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """The pairs whose texts are similar. sketches: node, sketch; pairs that they rule out need no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, known = Shingles(), {}
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                near = []
                for a, b, one, two in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    if len(known) > HELD:
                        known.clear()
                    for node, text in ((a, one), (b, two)):
                        if node not in known:  # a group's texts are in many pairs
                            known[node] = shingles.of(text)
                    near.append(similar(known[a], known[b]))
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
        shingles.clear()
        known.clear()
        release()

    pairs = written(pairs, "near-pairs")
    free_shuffles(texts.sparkSession)
    if sketches is not None:
        every, pairs = pairs, written(likely(pairs, sketches), "near-likely")
        drop_table(every)
        free_shuffles(texts.sparkSession)
    out = written(of_pairs(pairs, texts, "text").mapInArrow(run, "a long, b long"), "near-links")
    drop_table(pairs)
    free_shuffles(texts.sparkSession)
    return out


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """a, b: nodes whose fingerprints are equal or linked, as stars about one text of each fingerprint."""
    marked = written(fingerprints(texts, "text", "node", SHINGLE).distinct(), "near-fingerprints")
    stars = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("star"))
    same = marked.join(stars, "fingerprint").filter("doc_id != star").select(F.col("doc_id").alias("a"), F.col("star").alias("b"))
    one, two = (stars.select(F.col("fingerprint").alias(f), F.col("star").alias(n)) for f, n in (("a", "one"), ("b", "two")))
    near = links(stars.select("fingerprint")).distinct().join(one, "a").join(two, "b").select(F.greatest("one", "two").alias("a"), F.least("one", "two").alias("b"))
    return same.unionByName(near).distinct()


def near_copies(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, component_id (the smallest id that links of texts with a similarity of 4/5 reach).

    Texts without a word are equal to one another. A null id orders before all others and is returned as null. Rows that repeat
    an id are rows of their own. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    whole = whole_text(text)
    node = F.xxhash64(F.when(F.btrim(whole, F.lit(SPACES)) == "", F.lit("")).otherwise(whole))
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NULL_ID)).alias("id"), node.alias("node"), whole.cast("binary").alias("text"))
    found = verified(simhash_pairs(rows), rows)
    groups = written(components(found), "near-groups")
    common, keys, done = None, None, []
    for _ in range(ROUNDS):
        for last in done:
            drop_table(last)
        table = written(prefixes(rows, common), "near-prefixes")
        now = table.filter("node is not null")
        shared = written(shared_keys(rooted(now, groups)), "near-keys")
        done = [table, shared]
        free_shuffles(spark)
        met_there, often = shared.agg(F.coalesce(F.sum(F.col("many") * F.col("many")), F.lit(0)), F.count_if(F.col("many") > MANY)).first()
        first = common is None and not table.filter("node is null").isEmpty()
        if not first and (not often or met_there <= PAIRS * now.count()):
            break
        again = shared.filter(F.col("many") > MANY).select("key")
        if common is None:
            again = again.unionByName(table.filter("node is null").select(F.explode("keys").alias("key")))
        keys = written((again if keys is None else again.unionByName(keys)).distinct(), "near-common")
        common = key_bits(keys, "key")
    for every in (False, True):
        found = written(found.unionByName(verified(candidates(rooted(now, groups), shared, every), rows, now)), "near-found")
        groups = written(components(found), "near-groups")
    ids = written(rooted(rows.select("id", "node"), groups).select("id", "root"), "near-rooted")
    for last in [*done, groups, found]:
        drop_table(last)
    free_shuffles(spark)
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    null = F.lit(NULL_ID)
    return ids.join(least, "root").select(F.nullif("id", null).alias("doc_id"), F.nullif("component_id", null).alias("component_id"))
