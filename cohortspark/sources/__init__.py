"""Readers of domain text formats and writers of result tables."""
