"""Operators of a training-data pipeline: extraction, counting, dedup, filtering, mixing, scoring."""
