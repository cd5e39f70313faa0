"""Removal of long repeated strings with run-length indexes.

A string of 100 bytes has a smallest hash among its 32-grams. Positions are cut into ranges that share that anchor, so equal
strings lie in ranges with equal anchors, and only ranges whose anchor occurs again are looked at. Their bytes meet by anchor;
a block of them is indexed by its run-compressed transform, whose matching statistics mark what started earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import NULL_ID, documents, small_batches, whole_text, written
from skein.llm.keyfilter import key_filter, with_maybe
from skein.llm.run_index import later_copies

#: Fixed value: the length of the strings.
LENGTH = 100
#: Bytes that are hashed at once, and bytes of distinct ranges that an index holds; only ranges of one anchor may exceed it. Few, so that
#: what is made of them stays in a core's cache.
HASHED, INDEXED = 1 << 17, 1 << 17
#: Odd multipliers of the hash, one for each doubling.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def gram(length: int) -> int:
    """The anchor's length: a power of two of at most 32 and a third of the length."""
    return 1 << min(5, max(0, (length // 3).bit_length() - 1))


def anchor_ranges(texts: list[bytes], length: int, twice: bool = True) -> tuple[np.ndarray, ...]:
    """Ranges of string starts that share an anchor: text number, first start, number of starts, anchor, whether it is in the range twice; and the texts' bytes joined.

    Not twice: the last but one isn't looked for, and is false."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    k = gram(length)
    width = length - k + 1
    hashed = (joined.astype(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIERS[0])
    reach = 1
    for m in MULTIPLIERS[1 : k.bit_length()]:
        right = hashed[reach:]
        hashed = hashed[: len(right)] * np.uint64(m) + (right ^ right >> np.uint64(29))
        hashed ^= hashed >> np.uint64(32)
        reach *= 2
    least, reach = hashed, 1
    while reach < width and len(least):
        step = min(reach, width - reach)
        least = np.minimum(least[: max(0, len(least) - step)], least[step:])
        reach += step
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    starts = np.maximum(sizes - length + 1, 0)
    at = np.arange(int(starts.sum())) + np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(starts)[:-1])), starts)
    owner = np.repeat(np.arange(len(texts)), starts)
    anchor = least[at] if len(at) else np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    number = owner[first]
    start, count = at[first], np.diff(np.append(first, len(at)))
    # Starts behind the anchor's first place in a range have it from a second one. Equal strings in one range have that between them.
    again = np.zeros(len(first), bool)
    for a in range(0, len(first) if twice else 0, 8192):
        some = slice(a, a + 8192)
        place = (hashed[np.minimum(start[some, None] + np.arange(width), len(hashed) - 1)] == anchor[first[some], None]).argmax(axis=1)
        again[some] = count[some] > place + 1
    return number, start - offsets[number], count, anchor[first].view(np.int64), again, joined


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1]).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // HASHED, prepend=0))
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def repeated_anchors(docs: DataFrame, length: int) -> DataFrame:
    """docs: text, content (a hash of it). anchor of those that two contents have, or one has twice."""
    anchors = docs.mapInArrow(_emit_anchors(length), "anchor long, content long, twice boolean")
    return anchors.groupBy("anchor").agg(F.min("content").alias("a"), F.max("content").alias("b"), F.max("twice").alias("twice")).filter("a != b or twice").select("anchor")


def _emit_anchors(length: int, in_range: bool = True):
    """text, content of a document -> its anchors, each once, and whether one is in it twice (not in_range: in two ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, 0):
                number, _, _, anchor, again, _ = anchor_ranges(part.column(0).to_pylist(), length, in_range)
                content = part.column(1).to_numpy(zero_copy_only=False)[number]
                by = np.lexsort((anchor, number))
                new = np.ones(len(by), bool)
                new[1:] = (anchor[by][1:] != anchor[by][:-1]) | (number[by][1:] != number[by][:-1])
                first = np.flatnonzero(new)
                twice = np.diff(np.append(first, len(by))) > 1
                if len(by):
                    twice |= np.logical_or.reduceat(again[by], first)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[by][first]), pa.array(content[by][first]), pa.array(twice)], names=["anchor", "content", "twice"])

    return run


def _emit_ranges(length: int):
    """text, digest, did, anchors of a document -> anchor, did, digest, start and the bytes of each range with one of the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, 0):
                number, start, count, anchor, _, joined = anchor_ranges(part.column(0).to_pylist(), length, False)
                wanted = np.isin(anchor, part.column(3).flatten().to_numpy(zero_copy_only=False))
                number, start, count, anchor = number[wanted], start[wanted], count[wanted], anchor[wanted]
                sizes = np.diff(np.frombuffer(part.column(0).buffers()[1], np.int32)[part.column(0).offset :][: part.num_rows + 1]).astype(np.int64)
                at = (np.concatenate(([0], np.cumsum(sizes)))[number] + start).tolist()
                data = joined.tobytes()
                ranges = [data[a : a + n] for a, n in zip(at, (count + length - 1).tolist(), strict=True)]
                rows = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), part.column(2).take(rows), part.column(1).take(rows), pa.array(start), pa.array(ranges, pa.binary())], names=["anchor", "did", "digest", "start", "bytes"]
                )

    return run


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([False], marks, [False])).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


class _Block:
    """Ranges with whole anchors, to be indexed together. Each distinct range of an anchor is held once, as its earliest place."""

    def __init__(self, length: int):
        self.length, self.size = length, 0
        self.held: list[tuple[bytes, bytes, int]] = []  # bytes, digest, start: ordered by (document, start) within an anchor
        self.known: dict[bytes, tuple[bytes, int]] = {}
        self.out: list[tuple[bytes, int, int]] = []

    def add(self, digest: bytes, start: int, data: bytes) -> None:
        first = self.known.setdefault(data, (digest, start))
        if first == (digest, start):
            self.held.append((data, digest, start))
            self.size += len(data)
        else:
            self.out.append((digest, start, start + len(data) - self.length + 1))

    def new_anchor(self) -> None:
        self.known = {}

    def take(self) -> list[tuple[bytes, int, int]]:
        out, length = self.out, self.length
        if self.held:
            sizes = np.array([len(h[0]) for h in self.held], np.int64)
            ends = np.cumsum(sizes)
            text = np.frombuffer(b"".join(h[0] for h in self.held), np.uint8)
            left = np.repeat(ends, sizes) - np.arange(len(text))
            start = np.repeat(np.array([h[2] for h in self.held], np.int64) - (ends - sizes), sizes) + np.arange(len(text))
            # Within an anchor, which strings never leave, the text has documents and starts in their order.
            late = later_copies(text, length, left >= length)
            a, b = _runs(late)
            row = np.searchsorted(ends, a, side="right")
            out += [(self.held[r][1], x, x + n) for r, x, n in zip(row.tolist(), start[a].tolist(), (b - a).tolist(), strict=True)]
        self.size, self.held, self.known, self.out = 0, [], {}, []
        return out


def _mark(length: int):
    """Rows sorted by anchor, did, digest, start -> digest, a, b: starts of later copies, b exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = _Block(length), None

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["digest", "a", "b"])

        for batch in batches:
            for anchor, digest, start, data in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if anchor != now:
                    if block.size > INDEXED or len(block.out) > 200_000:
                        yield batch_of(block.take())
                    block.new_anchor()
                    now = anchor
                block.add(digest, start, data)
        yield batch_of(block.take())

    return run


def _rest(length: int):
    """text, digest, did, marks -> what is left of each distinct document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, digest, did, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans: list[list[int]] = []
                for m in sorted((m["a"], m["b"] + length - 1) for m in marks or ()):
                    if spans and m[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], m[1])
                    else:
                        spans.append(list(m))
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((digest, did, sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], kept.hexdigest()))
            names = ["digest", "first", "n_removed", "spans", "kept_sha256"]
            types = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return run


def repeated_strings(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, spans (start, end: the maximal runs of removed bytes), kept_sha256.

    A byte goes if a string of length bytes that covers it also starts earlier: in a document with a smaller id, or further up.
    Strings don't cross documents and are judged on the input. Null texts are empty. A null id comes before all others. Rows that
    repeat an id and its text are one document, and are all left the same; of different texts with one id the one with the
    smaller digest comes first. Other columns are ignored; an empty table gives no rows.

    Equal texts are collapsed before anything else: all but the first are wholly removed. Anchors are counted by sums that
    Spark makes before it shuffles; a common anchor's ranges are read as a stream, each distinct one once.
    """
    small_batches(docs.sparkSession)
    whole = whole_text(text).cast("binary")
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NULL_ID)).alias("did"), whole.alias("text"), F.unhex(F.md5(whole)).alias("digest"))
    content = F.xxhash64("digest").alias("content")
    repeated = written(repeated_anchors(rows.select("text", content), length), "anchors")
    anchors = rows.select("text", content).mapInArrow(_emit_anchors(length, False), "anchor long, content long, twice boolean").select("anchor", "content")
    anchors = with_maybe(anchors, ["anchor"], key_filter(repeated, ["anchor"], bits_per_key=8)).filter("_maybe")
    wanted = anchors.join(repeated, "anchor").groupBy("content").agg(F.collect_set("anchor").alias("anchors"))
    # Used twice in one plan; the filter, which keeps all, makes both the same to Spark, so that texts are shuffled once.
    distinct = rows.filter("digest is not null").groupBy("digest").agg(F.min("did").alias("did"), F.min("text").alias("text"))
    keyed = rows.select("digest", content).distinct().join(wanted, "content").select("digest", "anchors")
    ranges = distinct.join(keyed, "digest").select("text", "digest", "did", "anchors").mapInArrow(_emit_ranges(length), "anchor long, did long, digest binary, start long, bytes binary")
    marks = ranges.repartition("anchor").sortWithinPartitions("anchor", "did", "digest", "start").mapInArrow(_mark(length), "digest binary, a long, b long")
    marks = marks.groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    span = "array<struct<start:bigint,end:bigint>>"
    rest = distinct.join(marks, "digest", "left").select("text", "digest", "did", "marks")
    rest = written(rest.mapInArrow(_rest(length), f"digest binary, first long, n_removed long, spans {span}, kept_sha256 string"), "rest")
    size = F.octet_length("text").cast("long")
    copy = (F.col("did") != F.col("first")) & (F.col("n_bytes") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return (
        rows.select("did", "digest", size.alias("n_bytes"))
        .join(rest, "digest")
        .select(
            F.nullif("did", F.lit(NULL_ID)).alias("doc_id"),
            "n_bytes",
            F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(copy, all_of_it).otherwise(F.col("spans")).alias("spans"),
            F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        )
    )


def op1(spark, sf_dir: str) -> DataFrame:
    found = repeated_strings(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
