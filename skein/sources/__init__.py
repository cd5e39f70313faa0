"""Readers and writers of the binary and text formats."""
