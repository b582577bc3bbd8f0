"""Types at the sink: VARIANT values of a run as columns of the target's types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions import variants
from rowmill.operators.mapping import quoted
from rowmill.operators.transformations import INTEGRAL, is_decimal, to_text


def _held(c: Column, kind: str) -> Column:
    """The value as that type; null if it can't hold it exactly."""
    if kind == "string":
        return to_text(c, "variant")
    if kind in INTEGRAL:
        return variants.by_type(c, lambda n, v: v.try_cast(kind) if n == "bigint" else F.when(~F.contains(v, F.lit(".")), v.try_cast(kind)) if n == "exact" else None, F.lit(None).cast(kind))
    if is_decimal(kind):
        exact = lambda v: F.when(variants.plain(v.try_cast(kind).cast("string")) == variants.plain(v), v.try_cast(kind))
        return variants.by_type(c, lambda n, v: exact(v.cast("string")) if n in ("bigint", "exact") else None, F.lit(None).cast(kind))
    if kind in ("double", "float"):
        return variants.by_type(c, lambda n, v: v.cast(kind) if n in ("double", "bigint", "exact") else None, F.lit(None).cast(kind))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return variants.by_type(c, lambda n, v: v.cast(kind) if n == "timestamp_ntz" else None, F.lit(None).cast(kind))
    if kind == "boolean":
        return variants.by_type(c, lambda n, v: v if n == "boolean" else None, F.lit(None).cast(kind))
    raise ValueError(f"The sink type '{kind}' is not supported.")


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """rows with its VARIANT columns as the given types ('string' for those not named); a value that its column can't hold exactly fails the write."""
    columns = []
    for name, kind in rows.dtypes:
        c = quoted(name)
        if kind == "variant":
            to = types.get(name, "string")
            value = _held(c, to)
            shown = F.concat(F.lit("The value '"), to_text(c, "variant"), F.lit(f"' of the field '{name}' is no {to}."))
            c = F.when(c.isNotNull() & value.isNull(), F.raise_error(shown).cast(to)).otherwise(value)
        columns.append(c.alias(name))
    return rows.select(*columns)
