"""Pipelines: their definition, checks before a run, and their compilation to one DataFrame plan."""
