"""Validation rules: each gives the condition under which a row breaks it, and the message."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.functions import dates, numbers, text, variants
from rowmill.functions.locales import locale
from rowmill.operators.transformations import is_decimal
from rowmill.plans.spec import SourceOptions, Validation

# The names of rules and of their configuration, and the rows' messages, are fixed values.


def _range_message(field: str, low: str | None, high: str | None, unit: str = "") -> str:
    if low is not None and high is not None:
        return f"Field '{field}' must be between {low} and {high}{unit}."
    return f"Field '{field}' must be at least {low}{unit}." if low is not None else f"Field '{field}' must be at most {high}{unit}."


def _outside(value: Column, low, high) -> Column:
    out = F.lit(False)
    if low is not None:
        out = out | (value < low)
    if high is not None:
        out = out | (value > high)
    return out


def _date_bound(name: str, text: str, options: SourceOptions) -> datetime.datetime:
    where = locale(options.culture)
    if not text.strip():
        raise ValueError(f"The date range validation requires a non-empty '{name}' configuration value when it is supplied.")
    try:
        return dates.parse(text, options.date_format, where)
    except ValueError:
        raise ValueError(f"The date range validation '{name}' configuration value is not a valid date for culture '{where.name}'.") from None


def _length(name: str, value: str) -> int:
    if not re.fullmatch(r"[ \t-\r]*[+-]?[0-9]+[ \t-\r]*", value) or not -(2**31) <= int(value) < 2**31:
        raise ValueError(f"The text length range validation '{name}' configuration value '{value}' is not a valid whole number.")
    return int(value)


def _of_own_type(rule: Validation, c: Column, options: SourceOptions) -> tuple[Column, Column]:
    """A rule on VARIANT values: null breaks what it breaks as text, other values what they break by their type."""
    found = {name: broken(rule, variants.as_type(c, name), name, options) for name in variants.TYPES}
    missing, message = broken(rule, F.lit(None).cast("string"), "string", options)
    bad = F.when(c.isNull(), missing)
    for name, (one, _) in found.items():
        bad = bad.when(variants.is_type(c, name), one)
    return F.coalesce(bad, F.lit(False)), message


def broken(rule: Validation, c: Column, kind: str, options: SourceOptions) -> tuple[Column, Column]:
    """(whether a value breaks the rule, message). Values that are null or blank break only the required rules."""
    if kind == "variant":
        return _of_own_type(rule, c, options)
    is_text = kind == "string"
    present = text.has_value(c, is_text)
    where = locale(options.culture)
    low, high = rule.config.get("Minimum"), rule.config.get("Maximum")
    match rule.type:
        case "Required":
            bad, message = ~present, F.lit(f"Field '{rule.field}' is required.")
        case "UpsertKeyRequired":
            bad, message = ~present, F.lit(f"Upsert key field '{rule.field}' is required.")
        case "EmailFormat":
            bad, message = present & (~text.is_email(c) if is_text else F.lit(True)), F.lit(f"Field '{rule.field}' must be a valid email address.")
        case "NumericRange":
            bounds = [None if b is None else numbers.parse(str(b), where) for b in (low, high)]
            if None not in bounds and bounds[0] > bounds[1]:
                raise ValueError("A numeric range validation rule cannot have a 'Minimum' greater than its 'Maximum'.")
            if kind == "exact":
                outside = _outside(variants.parts(c), *(None if b is None else variants.parts_of(b) for b in bounds))
            else:
                outside = _outside(c, *(None if b is None else F.lit(b) for b in bounds)) if kind == "bigint" or is_decimal(kind) else F.lit(True)
            bad, message = present & outside, F.lit(_range_message(rule.field, *(None if b is None else f"{b:f}" for b in bounds)))
        case "TextLengthRange":
            bounds = [None if b is None else _length(name, str(b)) for name, b in (("Minimum", low), ("Maximum", high))]
            if any(b is not None and b < 0 for b in bounds) or (None not in bounds and bounds[0] > bounds[1]):
                raise ValueError("A text length validation rule needs whole numbers from 0, the minimum not above the maximum.")
            outside = _outside(text.utf16_length(c), *bounds) if is_text else F.lit(True)
            bad, message = present & outside, F.lit(_range_message(rule.field, *(None if b is None else str(b) for b in bounds), " characters"))
        case "DateRange":
            bounds = [None if b is None else _date_bound(name, str(b), options) for name, b in (("Minimum", low), ("Maximum", high))]
            if None not in bounds and bounds[0] > bounds[1]:
                raise ValueError("A date range validation rule cannot have a 'Minimum' later than its 'Maximum'.")
            outside = _outside(c, *(None if b is None else F.lit(b.isoformat()).cast("timestamp_ntz") for b in bounds)) if kind == "timestamp_ntz" else F.lit(True)
            shown = [None if b is None else f"{b:%Y-%m-%dT%H:%M:%S.%f}0".rjust(27, "0") for b in bounds]
            bad, message = present & outside, F.lit(_range_message(rule.field, *shown))
        case _:
            raise ValueError(f"The validation type '{rule.type}' is not supported.")
    if rule.message and rule.message.strip():
        message = F.lit(rule.message)
    return F.coalesce(bad, F.lit(False)), message
