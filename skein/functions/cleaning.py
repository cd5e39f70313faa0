"""Cleaning of sequence text, byte by byte, as nested replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What isspace() holds for, as a character class; the alphabet.
ISSPACE, ALPHABET = r" \t\n\x0B\f\r", "ACGT"
HEADER = r"((?:^|[\n\r])[ \t\x0B\f]*)>[^\n\r]*"


def as_bytes(text: Column) -> Column:
    """A character for each UTF-8 byte."""
    return F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1")


def without_headers(text: Column) -> Column:
    """Bytes without NULs and without header lines; their line ends and indents stay."""
    return F.regexp_replace(F.replace(as_bytes(text), F.lit("\x00")), HEADER, "$1")


def clean_sequence(text: Column) -> Column:
    """A, C, G and T as they are and any other symbol as A, without NULs, white space and header lines."""
    return F.regexp_replace(F.regexp_replace(without_headers(text), f"[{ISSPACE}]", ""), f"[^{ALPHABET}]", "A")


def cleaning_counters(text: Column) -> dict[str, Column]:
    """What cleaning does to a text: the line end of a header isn't counted as white space."""
    whole = as_bytes(text)
    bare = F.replace(whole, F.lit("\x00"))
    rest = without_headers(text)
    ended = F.regexp_count(bare, F.lit(HEADER + r"(?=[\n\r])"))
    blank = F.length(rest) - F.length(F.regexp_replace(rest, f"[{ISSPACE}]", ""))
    symbols = F.regexp_replace(rest, f"[{ISSPACE}]", "")
    return {
        "sequence_length": F.length(symbols),
        "replacement_count": F.length(F.regexp_replace(symbols, f"[{ALPHABET}]", "")),
        "header_lines_removed": F.regexp_count(bare, F.lit(HEADER)),
        "whitespace_characters_removed": blank - ended,
        "nul_bytes_removed": F.length(whole) - F.length(bare),
    }


def strip_sequence(text: Column, end: str = "") -> Column:
    """The plainer cleaning: header lines and white space go, the alphabet stays; end is put behind it."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "(?m)^>.*$", ""), r"\s", ""), F.lit(end))
