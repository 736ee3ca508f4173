"""Reusable plan fragments: cutting lineage, size-checked joins, graphs."""
