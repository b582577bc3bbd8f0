"""Sinks: keyed tables that are upserted, relational tables, and the error report."""
