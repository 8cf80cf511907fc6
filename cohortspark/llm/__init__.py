"""Operators of a training-data pipeline: de-duplication, scoring, filtering and encoding of texts."""
