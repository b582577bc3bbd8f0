"""Values with a type of their own in each row: VARIANT columns, told apart by what they hold."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a value can be, and how schema_of_variant writes it.
TYPES = {"string": "STRING", "bigint": "BIGINT", "exact": "DECIMAL", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP_NTZ"}


def carried(c: Column, kind: str) -> Column:
    """A column as VARIANT of one of TYPES; dates and zoned timestamps become timestamps, a VARIANT null becomes null."""
    if kind == "variant":
        return F.when(~F.is_variant_null(c), c)
    if kind in ("tinyint", "smallint", "int"):
        c = c.cast("bigint")
    elif kind in ("date", "timestamp"):
        c = c.cast("timestamp_ntz")
    elif kind == "float":
        c = c.cast("double")
    return c.cast("variant")


def is_type(c: Column, name: str, shown: Column | None = None) -> Column:
    """Whether a value is of one of TYPES; false for null. shown: its schema_of_variant, where that is at hand."""
    shown = F.schema_of_variant(c) if shown is None else shown
    return F.coalesce(F.startswith(shown, F.lit("DECIMAL")) if name == "exact" else shown == TYPES[name], F.lit(False))


def as_type(c: Column, name: str) -> Column:
    """The value as a column of that type, an exact decimal as its plain text."""
    return F.try_variant_get(c, "$", "string" if name == "exact" else name)


def by_type(c: Column, each: Callable[[str, Column], Column | None], otherwise: Column) -> Column:
    """each(name, typed column) for the type that a value has; where that is None, or for other types, otherwise."""
    out = None
    for name in TYPES:
        found = each(name, as_type(c, name))
        if found is not None:
            out = F.when(is_type(c, name), found) if out is None else out.when(is_type(c, name), found)
    return otherwise if out is None else out.otherwise(otherwise)


def decimal_of(number: Column) -> Column:
    """An exact decimal, of its own scale, from plain text (sign, digits, point, digits): VARIANT."""
    whole = ~F.contains(number, F.lit("."))
    return F.when(whole, number.try_cast("decimal(38,0)").cast("variant")).otherwise(F.parse_json(F.when(~whole, number)))


def parts(number: Column) -> Column:
    """A plain text's number as (whole, part) of its own sign, whose order is that of the numbers: no scale is given up."""
    sign = F.when(F.startswith(number, F.lit("-")), "-").otherwise("")
    part = F.concat(sign, F.lit("0."), F.substring_index(number, ".", -1))
    return F.struct(F.substring_index(number, ".", 1).try_cast("decimal(38,0)").alias("whole"), F.when(F.contains(number, F.lit(".")), part.try_cast("decimal(28,28)")).otherwise(F.lit(0).cast("decimal(28,28)")).alias("part"))


def parts_of(number: Decimal) -> Column:
    return parts(F.lit(f"{number:f}"))


def plain(text: Column) -> Column:
    """A decimal's text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def identity(c: Column, by_value: bool) -> Column:
    """Text that equal values, and no others, share; null for null. by_value: numbers of all types are compared by their value, dates in whole milliseconds; a number that is not finite has none."""

    def each(name: str, value: Column) -> Column:
        if not by_value:
            return F.concat(F.lit(f"{name}:"), plain(value) if name == "exact" else value.cast("string"))
        if name == "double":
            finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
            return F.when(finite, F.concat(F.lit("n:"), plain(value.try_cast("decimal(38,12)").cast("string"))))
        if name == "timestamp_ntz":
            micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value)
            return F.concat(F.lit("t:"), F.when(micros >= 0, F.floor(micros / 1000)).otherwise(-F.floor(-micros / 1000)).cast("string"))
        if name in ("bigint", "exact"):
            return F.concat(F.lit("n:"), plain(value.cast("string")) if name == "exact" else value.cast("string"))
        return F.concat(F.lit(f"{name}:"), value.cast("string"))

    return by_type(c, each, F.lit(None).cast("string"))
