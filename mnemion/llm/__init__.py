"""Operators for large text corpora: extraction, deduplication, scoring, mixing and encoding."""
