"""Predicates on sets as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def includes(big: Column, small: Column) -> Column:
    """Whether a set has all elements of another."""
    return F.size(F.array_except(small, big)) == 0


def contains_run(big: Column, small: Column) -> Column:
    """Whether an array has another as a contiguous part; an empty one in a non-empty one is, in an empty one it isn't."""
    last = F.size(big) - F.size(small)
    found = F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(big, k + 1, F.size(small)) == small)
    return F.when((last < 0) | (F.size(big) == 0), F.lit(False)).when(F.size(small) == 0, F.lit(True)).otherwise(found)


def set_text(elems: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(elems, ", "), F.lit("}"))
