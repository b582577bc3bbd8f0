"""JSON documents, shaped strictly to an expected schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coarse types and the Spark types that hold them.
SPARK = {"String": "string", "Integer": "bigint", "Decimal": "decimal(38,10)", "Boolean": "boolean", "Unknown": "string"}


def documents(df: DataFrame, json_column: str, *keep: str) -> DataFrame:
    """JSON text as a VARIANT column doc. Text that is no JSON fails."""
    return df.select(*keep, F.parse_json(json_column).alias("doc"))


def _kinds(kind: str) -> Column:
    of = {"String": ["STRING"], "Integer": ["BIGINT"], "Boolean": ["BOOLEAN"], "Unknown": []}
    return F.array(*(F.lit(x) for x in of.get(kind, []))).cast("array<string>")


def shape(docs: DataFrame, expected: list[tuple[str, str]], column: str = "doc") -> DataFrame:
    """One column for each expected field; a missing or null value is null.

    A value of another kind, a nested value, or a field that is not expected fails the run: kinds are looked at before values
    are read, since reading would convert.
    """
    out = [c for c in docs.columns if c != column]
    known = F.array(*(F.lit(n) for n, _ in expected)).cast("array<string>")
    checked = docs
    fields = []
    for name, kind in expected:
        path = f"$['{name}']"
        value = F.try_variant_get(F.col(column), path, "variant")
        found = F.schema_of_variant(value)
        fits = found.isin("VOID") | F.array_contains(_kinds(kind), found)
        if kind == "Decimal":
            fits = fits | found.startswith("DECIMAL") | found.isin("BIGINT", "DOUBLE")
        bad = F.raise_error(F.concat(F.lit(f"The source schema has changed: field '{name}' is "), found, F.lit(f", not {kind}."))).cast(SPARK[kind])
        got = F.when(value.isNull() | (found == "VOID"), F.lit(None).cast(SPARK[kind])).when(~fits, bad).otherwise(F.try_variant_get(F.col(column), path, SPARK[kind]))
        fields.append(got.alias(name))
    keys = F.map_keys(F.try_variant_get(F.col(column), "$", "map<string,variant>"))
    extra = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), known)
    first = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("The source schema has changed: unexpected field "), extra[0])).cast("boolean")).otherwise(F.lit(True))
    checked = checked.where(first)
    return checked.select(*out, *fields)
