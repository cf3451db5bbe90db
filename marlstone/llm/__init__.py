"""Operators for text corpora: repair, pair checks, repeated lines, duplicates, neighbours, splitting, packing, leaks, spans."""
