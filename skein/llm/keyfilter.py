"""Bitmaps of keys, small enough to broadcast or not used at all: rows whose key isn't in one need no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest bitmap that is broadcast. Keys share its bits more and more as they grow in number; beyond half of the bits there is none.
FILTER_BYTES = 16 << 20


def _bits(keys: int, bits_per_key: int, max_bytes: int) -> int | None:
    """A power of two: so many bits a key, or as many as max_bytes has; None if that is under two bits a key."""
    bits = min(1 << max(15, (keys * bits_per_key - 1).bit_length()), 1 << (8 * max_bytes).bit_length() >> 1)
    return bits if bits >= max(2 * keys, 1 << 15) else None


def _bitmap(rows: DataFrame, place: Column) -> DataFrame:
    return rows.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bitmap"))


def _place(keys: list[str], bits: int) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1)) + 1


def key_filter(rows: DataFrame, keys: list[str], max_bytes: int = FILTER_BYTES, bits_per_key: int = 16) -> tuple[DataFrame, int] | None:
    """The bitmap of the rows' keys as rows (bucket, bitmap), and its number of bits; None if there are too many keys for max_bytes."""
    bits = _bits(rows.count(), bits_per_key, max_bytes)
    return None if bits is None else (_bitmap(rows, _place(keys, bits)), bits)


def with_maybe(rows: DataFrame, keys: list[str], found: tuple[DataFrame, int] | None) -> DataFrame:
    """rows with a column _maybe: false only if the key is certainly not in the filter."""
    if found is None:
        return rows.withColumn("_maybe", F.lit(True))
    bitmap, bits = found
    place = _place(keys, bits)
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).withColumn("_bit", F.bitmap_bit_position(place))
    byte = F.expr("cast(conv(hex(substring(_bitmap, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    return (
        marked.join(F.broadcast(bitmap), "_bucket", "left")  # at most max_bytes of key_filter
        .withColumn("_maybe", F.coalesce(F.getbit(byte, F.expr("cast(_bit % 8 as int)")) == 1, F.lit(False)))
        .drop("_bucket", "_bit", "_bitmap")
    )


class KeyBits:
    """The same for Python workers, of keys that are hashes themselves."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        place = keys & (8 * len(self.bits) - 1)
        return self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


def key_bits(rows: DataFrame, key: str, max_bytes: int = FILTER_BYTES, bits_per_key: int = 16) -> KeyBits | None:
    """The bitmap of a column of hashes, collected: at most max_bytes. None if there are too many keys for that."""
    bits = _bits(rows.count(), bits_per_key, max_bytes)
    if bits is None:
        return None
    out = np.zeros(bits // 8, np.uint8)
    for row in _bitmap(rows, F.col(key).bitwiseAND(F.lit(bits - 1)) + 1).collect():  # 4 KB each
        at = (row["_bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["_bitmap"], np.uint8)
    return KeyBits(out)


#: Bits of a part of a bitmap, and keys that a worker gathers at least before it deals them out to parts.
PART_BITS, PART_KEYS = 1 << 21, 1_000_000


def packed_key_bits(rows: DataFrame, keys: str, many: str, max_bytes: int = FILTER_BYTES, bits_per_key: int = 16) -> KeyBits | None:
    """The same of hashes that come packed: keys has those of a row as bytes (int64), many their number."""
    bits = _bits(int(rows.agg(F.coalesce(F.sum(many), F.lit(0))).first()[0]), bits_per_key, max_bytes)
    if bits is None:
        return None
    size = min(bits, PART_BITS)
    shift = size.bit_length() - 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def flush() -> pa.RecordBatch:
            place = np.frombuffer(b"".join(held), np.int64) & (bits - 1)
            part = (place >> shift).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            ends = np.cumsum(np.bincount(part, minlength=bits >> shift))
            places = np.split((place[order] & (size - 1)).astype(np.int32), ends[:-1])
            some = [k for k, x in enumerate(places) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([places[k].tobytes() for k in some], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for row in batch.column(0).to_pylist():
                held.append(row)
                waiting += len(row) // 8
                if waiting > PART_KEYS:
                    yield flush()
                    held, waiting = [], 0
        if waiting:
            yield flush()

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flags = None, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != now:
                    if now is not None:
                        yield flush()
                    now, flags = row["part"], np.zeros(size, bool)
                flags[np.frombuffer(row["bits"], np.int32)] = True
        if now is not None:
            yield flush()

    out = np.zeros(bits // 8, np.uint8)
    parts = rows.select(keys).mapInArrow(dealt, "part int, bits binary").repartition("part").sortWithinPartitions("part")
    for row in parts.mapInArrow(drawn, "part int, bits binary").collect():  # max_bytes at most together
        at = row["part"] * size // 8
        out[at : at + size // 8] = np.frombuffer(row["bits"], np.uint8)
    return KeyBits(out)
