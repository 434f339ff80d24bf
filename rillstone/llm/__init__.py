"""Operators of a training-data pipeline: tokenizing, filtering, deduplicating, searching and mixing documents."""
