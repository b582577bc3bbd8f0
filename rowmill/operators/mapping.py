"""Field mapping: which source columns go on, under which names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.plans.spec import FieldMapping


def active(mappings: tuple[FieldMapping, ...], columns: list[str]) -> list[FieldMapping]:
    """The included mappings in order; ValueError if they can't be applied to the columns."""
    used = [m for m in mappings if m.included]
    if not used:
        raise ValueError("At least one field mapping must be active.")
    sources, targets = set(), set()
    for m in used:
        if not m.target.strip():
            raise ValueError(f"The active mapping for source field '{m.source}' has an empty target field name.")
        if m.source not in columns:
            raise ValueError(f"Mapped source field '{m.source}' does not exist in the expected source schema.")
        if m.source in sources:
            raise ValueError(f"Source field '{m.source}' has more than one active mapping.")
        if m.target in targets:
            raise ValueError(f"Target field '{m.target}' is used by more than one active mapping.")
        sources.add(m.source)
        targets.add(m.target)
    return used


def quoted(name: str) -> Column:
    """A top-level column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def apply(df: DataFrame, mappings: tuple[FieldMapping, ...]) -> DataFrame:
    return df.select(*(quoted(m.source).alias(m.target) for m in active(mappings, df.columns)))
