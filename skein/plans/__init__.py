"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from skein.plans import color_sets, sequences

QUERIES: dict = sequences.QUERIES | color_sets.QUERIES
ORACLE_SQL: dict[str, str] = sequences.ORACLE_SQL | color_sets.ORACLE_SQL
