"""Operators over tables: retrieval, checks, judge, taxonomy, aggregation, validation."""
