"""Scalar functions as column expressions: cleaning of sequence text, packed k-mers, bit widths, set predicates."""
