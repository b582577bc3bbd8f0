"""Operators on DataFrames: mapping, transformations, validations, deduplication, schemas and counters."""
