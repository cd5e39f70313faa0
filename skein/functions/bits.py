"""Packed k-mers and bit widths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of a packed k-mer and the bits of its lower half.
KMER, LOW_BITS = 16, 16


def symbol_codes(text: Column) -> Column:
    """A 0, C 1, G 2, T 3; anything else 0."""
    return F.translate(F.regexp_replace(text, "[^ACGT]", "A"), "ACGT", "0123")


def pack_kmer(kmer: Column) -> Column:
    """Two bits a symbol, the first one highest."""
    return F.conv(symbol_codes(kmer), 4, 10).cast("long")


def roll_kmer(key: Column, symbol: Column) -> Column:
    """The packed k-mer one symbol further on."""
    return F.pmod(key * 4 + F.conv(symbol_codes(symbol), 4, 10).cast("long"), F.lit(1 << (2 * KMER)))


def bucket(key: Column) -> Column:
    return F.shiftright(key, LOW_BITS)


def low(key: Column) -> Column:
    return key.bitwiseAND((1 << LOW_BITS) - 1)


def bits_required(x: Column) -> Column:
    """The bits of a number, at least one."""
    return F.length(F.bin(x))


def common_bits(a: Column, b: Column) -> Column:
    """Leading bits that two buckets share: 16 less the bits of their difference, 32 if they are equal."""
    return F.when(a == b, F.lit(32)).otherwise(F.lit(LOW_BITS) - F.length(F.bin(a.bitwiseXOR(b))))
