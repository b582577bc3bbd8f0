"""A look at a source before a pipeline is made: its fields, its first rows, and the schema that these suggest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from rowmill.operators import schema
from rowmill.operators.counters import preview
from rowmill.plans.spec import SourceOptions


@dataclass(frozen=True)
class Inspection:
    """Names of the fields, the first rows with their numbers, and (position, field, type)."""

    fields: list[str]
    rows: DataFrame
    schema: DataFrame


def inspect(source: DataFrame, row_number: str, options: SourceOptions = SourceOptions(), limit: int = 100) -> Inspection:
    """Looks at the first `limit` rows in source order. A source without fields is an error."""
    fields = [c for c in source.columns if c != row_number]
    if not fields:
        raise ValueError("The source has no fields.")
    rows = preview(source, row_number, limit)
    return Inspection(fields, rows, schema.infer(rows.select(*(schema.quoted(c) for c in fields)), options))
