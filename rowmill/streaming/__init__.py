"""Runs in micro-batches over arriving files."""
