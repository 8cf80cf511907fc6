"""Cohort-scale association analytics as plain Spark DataFrame jobs."""
