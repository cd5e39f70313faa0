"""SimHash near-dedup with a covering code: fingerprints meet at codewords near both, and are compared there.

The anchors are pairs of codewords of the binary Golay code of length 23, which covers its space with radius 3: one for bits 0-22
and one for bits 23-45. If two fingerprints differ in at most t bits, a point between them is at most ceil(t/2) bits from either,
and its nearest anchor is within the covering radius. So both are found at that anchor if each is replicated to all anchors within
the covering radius plus ceil(t/2), the half of the threshold that falls to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import NULL_ID, documents, remembered, small_batches, whole_text, written
from skein.llm.components import components

#: The words of a shingle, the hash's seed, the most differing bits of a link.
SHINGLE, SEED, THRESHOLD = 3, 42, 3
#: Fixed values of the Golay code: length, dimension, covering radius, generator polynomial.
LENGTH, DIMENSION, RADIUS, GENERATOR = 23, 12, 3, 0xC75
#: Rows of complete groups that are compared at once, and the group size from which a search takes the place of all shifts.
BLOCK, LARGE = 100_000, 48
#: Fingerprints that are compared at an anchor of two codewords at most; more are split by a third one. It decides where, not what is found.
MOST = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()  # of bytes: A-Z and the six ASCII spaces
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        hashes = np.array([digest(whole[a:b], seed) for a, b in zip(starts[k : min(n, k + (1 << 16))], last[k : k + (1 << 16)])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (its 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("simhash")
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                found = np.array([fingerprint(x, shingle, seed) for x in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "fingerprint"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


@lru_cache(maxsize=1)
def syndrome_tables() -> list[np.ndarray]:
    """The remainder of a 23-bit word by the generator, from its three bytes."""

    def remainder(x: int) -> int:
        for k in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - (LENGTH - DIMENSION))
        return x

    return [np.array([remainder(b << shift) if b << shift < 1 << LENGTH else 0 for b in range(256)], np.int64) for shift in (0, 8, 16)]


def syndromes(words: np.ndarray) -> np.ndarray:
    low, mid, high = syndrome_tables()
    return low[words & 255] ^ mid[words >> 8 & 255] ^ high[words >> 16]


@lru_cache(maxsize=4)
def differences(most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each cost 0..most: by syndrome, the differences to all codewords whose distance is that cost beyond the radius (at cost 0: within it), and which places of the table are filled."""
    by_cost: list[list[list[int]]] = [[[] for _ in range(1 << (LENGTH - DIMENSION))] for _ in range(most + 1)]
    for weight in range(RADIUS + most + 1):
        words = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        for word, s in zip(words.tolist(), syndromes(words).tolist(), strict=True):
            by_cost[max(0, weight - RADIUS)][s].append(word)
    out = []
    for table in by_cost:
        wide = max(map(len, table))
        out.append((np.array([x + [0] * (wide - len(x)) for x in table], np.int64), np.array([[k < len(x) for k in range(wide)] for x in table])))
    return out


def anchors(values: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """values: fingerprints as unsigned. Rows (index into values, anchor): all anchors within the radius plus half the threshold."""
    most = (threshold + 1) // 2
    table = differences(most)
    mask = np.uint64((1 << LENGTH) - 1)
    blocks = [(values >> np.uint64(LENGTH * k) & mask).astype(np.int64) for k in (0, 1)]
    marks = [syndromes(b) for b in blocks]
    rows, out = [], []
    for one in range(most + 1):
        for two in range(most + 1 - one):
            (d1, full1), (d2, full2) = table[one], table[two]
            first, second = blocks[0][:, None] ^ d1[marks[0]], blocks[1][:, None] ^ d2[marks[1]]
            filled = full1[marks[0]][:, :, None] & full2[marks[1]][:, None, :]
            both = (first[:, :, None] << LENGTH) | second[:, None, :]
            rows.append(np.nonzero(filled)[0])
            out.append(both[filled])
    return np.concatenate(rows), np.concatenate(out)


def linked(anchor: np.ndarray, value: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of one anchor that keep what is reachable. anchor: sorted; value: unsigned fingerprints."""
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(starts, len(anchor)))
    left, right = [], []
    for a, n in zip(starts[sizes > LARGE].tolist(), sizes[sizes > LARGE].tolist(), strict=True):
        rest = np.unique(value[a : a + n])
        while len(rest):  # each value is compared with those that no other has reached
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                x = reached.pop()
                near = np.bitwise_count(rest ^ x) <= threshold
                if near.any():
                    left.append(np.full(int(near.sum()), x))
                    right.append(rest[near])
                    reached += list(rest[near])
                    rest = rest[~near]
    small = np.repeat(sizes <= LARGE, sizes)
    at, shift = np.flatnonzero(small), 1
    while len(at):
        at = at[at + shift < len(anchor)]
        at = at[anchor[at] == anchor[at + shift]]
        near = at[np.bitwise_count(value[at] ^ value[at + shift]) <= threshold]
        left.append(value[near])
        right.append(value[near + shift])
        shift += 1
    if not left:
        return value[:0], value[:0]
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def third_anchors(values: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Rows (index into values, number of a codeword): the codewords for the last 23 bits, within the radius plus half the threshold."""
    words = (values >> np.uint64(64 - LENGTH)).astype(np.int64)
    marks = syndromes(words)
    rows, out = [], []
    for offsets, full in differences((threshold + 1) // 2):
        filled = full[marks]
        rows.append(np.nonzero(filled)[0])
        out.append((words[:, None] ^ offsets[marks])[filled] >> (LENGTH - DIMENSION))  # the code's first bits number its words
    return np.concatenate(rows), np.concatenate(out)


def _meet(met: DataFrame, threshold: int, most: int | None) -> DataFrame:
    """met: anchor, fingerprint. Rows a, b, postponed: links among the rows of each anchor; or, of an anchor with over most rows, the
    anchor and each fingerprint, passed on as they come. So a task holds BLOCK and most rows, however many one anchor has."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, large = 0, None  # large: the anchor whose rows pass

        def out(a: np.ndarray, b: np.ndarray, postponed: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), postponed))], names=["a", "b", "postponed"])

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, large
            anchor, value = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            cut = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            complete = np.arange(len(anchor)) < cut
            if most is not None:
                starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                sizes = np.diff(np.append(starts, len(anchor)))
                many = np.repeat((sizes > most) | (anchor[starts] == large if large is not None else False), sizes)
                if many.any():
                    yield out(anchor[many], value[many], True)
                large = int(anchor[-1]) if many[-1] else None
                anchor, value, complete = anchor[~many], value[~many], complete[~many]
            held, rows = [(anchor[~complete], value[~complete])], int((~complete).sum())
            a, b = linked(anchor[complete], value[complete].view(np.uint64), threshold)
            yield out(a, b, False)

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows >= BLOCK:
                yield from flush(False)
        if rows:
            yield from flush(True)

    return met.repartition("anchor").sortWithinPartitions("anchor", "fingerprint").mapInArrow(compare, "a long, b long, postponed boolean")


def links(distinct: DataFrame, threshold: int = THRESHOLD, most: int = MOST) -> DataFrame:
    """distinct: fingerprint (long, each once). Rows a, b whose reachability is that of all links; a link may be found at several anchors.

    An anchor with over most fingerprints isn't compared: these go to anchors of three codewords, the third one for the last 23 bits.
    The point between two linked fingerprints is near both there, too, so that no link is lost. An empty table gives no rows.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(values), 2048):
                part = values[k : k + 2048]
                rows, out = anchors(part.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(part[rows])], names=["anchor", "fingerprint"])

    def spread_further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, values = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for k in range(0, len(values), 2048):
                part = values[k : k + 2048]
                rows, out = third_anchors(part.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[k : k + 2048][rows] << DIMENSION | out), pa.array(part[rows])], names=["anchor", "fingerprint"])

    found = written(_meet(distinct.select("fingerprint").mapInArrow(spread, "anchor long, fingerprint long"), threshold, most), "links")
    pairs, late = found.filter("not postponed").select("a", "b"), found.filter("postponed").select("a", "b")
    if late.isEmpty():
        return pairs
    return pairs.unionByName(_meet(late.mapInArrow(spread_further, "anchor long, fingerprint long"), threshold, None).select("a", "b"))


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", threshold: int = THRESHOLD, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (long), component_id (the smallest id that links reach).

    Texts without words (or null) have the fingerprint zero and are linked like any other. Equal fingerprints are compared once,
    however many rows have them. A null id orders before all others and is returned as null. Rows that repeat an id are rows of
    their own. Other columns are ignored; an empty table gives no rows.
    """
    marked = written(fingerprints(docs, text, id, shingle, seed).withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID))), "fingerprints")
    distinct = marked.groupBy("fingerprint").agg(F.min("id").alias("least"))
    found = components(links(distinct, threshold))
    rooted = distinct.join(found, distinct["fingerprint"] == found["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(rooted.join(least, "root").select("fingerprint", "component_id"), "classes")
    return marked.join(classes, "fingerprint").select("doc_id", "fingerprint", F.nullif("component_id", F.lit(NULL_ID)).alias("component_id"))


def op7(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
