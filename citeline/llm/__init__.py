"""Operators of a training-data pipeline: cleaning, deduplication, scoring,
formatting and mixing of text. Nothing else in the package imports this one."""
