"""Parsing sequences as they arrive: stateless, so that any sink and restart from a checkpoint will do."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skein.operators import parse


def parse_stream(rows: DataFrame, id: str, data: str, reference: parse.Reference) -> DataFrame:
    """rows: a streaming table. The phrases of each row, as parse.phrase_rows has them."""
    if not rows.isStreaming:
        raise ValueError("not a stream")
    return parse.phrase_rows(parse.parse(rows, id, data, reference), id)
