"""Row transformations: each gives the new value of a field, its type, and the errors that end a row."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.functions import dates, numbers, text, variants
from rowmill.functions.locales import Locale, locale
from rowmill.plans.spec import SourceOptions, Transformation

#: Of the same kind for comparison and conversion.
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


@dataclass
class Outcome:
    """value and kind of the field after the step; errors as (condition, message ending); drop: rows to filter."""

    value: Column
    kind: str
    errors: list[tuple[Column, str]] = field(default_factory=list)
    drop: Column | None = None
    subject: str = ""


def is_decimal(kind: str) -> bool:
    return kind.startswith("decimal")


def _unsupported(c: Column, kind: str, subject: str) -> Outcome:
    return Outcome(c, kind, [(c.isNotNull(), f" has unsupported value type '{kind}'.")], subject=subject)


def to_text(c: Column, kind: str) -> Column | None:
    """A value as text in invariant notation, None for a type that has none."""
    if kind == "string":
        return c
    if kind == "boolean":
        return F.initcap(c.cast("string"))
    if kind in INTEGRAL:
        return c.cast("string")
    if is_decimal(kind):
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if kind in ("timestamp_ntz", "timestamp", "date"):
        return F.date_format(c, "MM/dd/yyyy HH:mm:ss")
    if kind == "exact":
        return variants.plain(c)
    if kind == "variant":
        return variants.by_type(c, lambda name, value: to_text(value, name), F.lit(None).cast("string"))
    if kind in ("double", "float"):
        shown = c.cast("string")
        plain = F.regexp_replace(F.regexp_replace(shown.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(shown, r"\.0(?=E|$)", ""), r"E(?=\d)", "E+"), r"E([+-])(\d)$", "E$10$2")
        return F.when((c == 0) | (F.abs(c) >= 1e-4) & (F.abs(c) < 1e15), plain).otherwise(exponent)
    return None


def _compare(operator: str, a: Column, b: Column) -> Column:
    return {"Equals": a == b, "NotEquals": a != b, "GreaterThan": a > b, "GreaterThanOrEqual": a >= b, "LessThan": a < b, "LessThanOrEqual": a <= b}[operator]


def filter_row(c: Column, kind: str, operator: str, value: str, where: Locale, date_format: str | None) -> Outcome:
    """Drops rows whose value compares so with the constant. Null never does. A constant that is no value of the field's type fails each row with a value."""
    subject = "The conditional filter comparison value for field"
    bad = [(c.isNotNull(), "")]
    if kind == "string":
        ranged = operator not in ("Equals", "NotEquals")
        drop = _compare(operator, text.utf16(c), text.utf16(F.lit(value))) if ranged else _compare(operator, c, F.lit(value))
        return Outcome(c, kind, drop=drop)
    if kind == "bigint" or kind == "exact" or is_decimal(kind):
        name = "Int64" if kind == "bigint" else "Decimal"
        try:
            number = numbers.parse(value, where)
            if kind == "bigint" and number != number.to_integral_value():
                raise ValueError
            if kind == "bigint" and not numbers.INT64[0] <= number <= numbers.INT64[1]:
                raise OverflowError
        except ValueError:
            return Outcome(c, kind, [(bad[0][0], f" is not a valid {name} value for culture '{where.name}'.")], subject=subject)
        except OverflowError:
            return Outcome(c, kind, [(bad[0][0], f" cannot be represented exactly as a {name} value for culture '{where.name}'.")], subject=subject)
        if kind == "exact":
            return Outcome(c, kind, drop=_compare(operator, variants.parts(c), variants.parts_of(number)))
        return Outcome(c, kind, drop=_compare(operator, c, F.lit(int(number)).cast("bigint") if kind == "bigint" else F.lit(number)))
    if kind == "timestamp_ntz":
        bound = dates.date_of(F.lit(value), date_format, where)
        errors = dates.errors_of(F.lit(value), bound, date_format, where)
        return Outcome(c, kind, [(c.isNotNull() & cond, m) for cond, m in errors], drop=_compare(operator, c, bound), subject=subject)
    return _unsupported(c, kind, "The conditional filter transformation field")


def constant(value: str, kind: str) -> Column:
    """A default as a value of a column's type; ValueError if it is none, since such a column can hold no other."""
    try:
        if kind in INTEGRAL:
            bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[kind]
            if not -(2 ** (bits - 1)) <= int(value) < 2 ** (bits - 1):
                raise ValueError
        elif is_decimal(kind):
            precision, scale = (int(x) for x in re.findall(r"\d+", kind))
            number = Decimal(value)
            if not number.is_finite() or -number.normalize().as_tuple().exponent > scale or abs(number) >= Decimal(10) ** (precision - scale):
                raise ValueError
        elif kind in ("double", "float"):
            float(value)
        elif kind == "boolean":
            if value.lower() not in ("true", "false"):
                raise ValueError
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            datetime.datetime.fromisoformat(value)
        else:
            raise ValueError
    except (ValueError, ArithmeticError):
        raise ValueError(f"The default value '{value}' is no value of the type '{kind}' that the field has by then. Set the pipeline's carrier to 'variant' to mix types in a field.") from None
    return F.lit(value).cast(kind)


def _of_own_type(rule: Transformation, c: Column, options: SourceOptions, keep: Callable[[Column], Column]) -> Outcome:
    """A rule on VARIANT values: what it does to each type, on the rows that hold it."""
    where = locale(options.culture)
    if rule.type == "SetDefaultValue":
        missing = c.isNull() | (variants.is_type(c, "string") & (variants.as_type(c, "string") == ""))
        return Outcome(F.when(F.coalesce(missing, F.lit(True)), F.lit(str(rule.config["Value"])).cast("variant")).otherwise(c), "variant")
    if rule.type == "ConvertToString":
        return Outcome(to_text(c, "variant").cast("variant"), "variant")
    shown_type = keep(F.schema_of_variant(c))
    if rule.type == "ConvertToDecimal":
        texts = keep(numbers.normal_text(F.when(variants.is_type(c, "string", shown_type), variants.as_type(c, "string")), where))
    value, errors, drops, subject = c, [], [], ""
    for name in variants.TYPES:
        if rule.type in ("Trim", "ToUpper", "ToLower", "FindAndReplace") and name != "string":
            continue
        held, typed = variants.is_type(c, name, shown_type), variants.as_type(c, name)
        if rule.type == "ConvertToDecimal" and name in ("string", "bigint", "exact", "double"):
            subject = "The convert to decimal transformation field"
            if name == "double":
                shown = to_text(typed, "double")
                large = typed.try_cast("decimal(38,0)")
                number = F.when(shown.rlike(r"^-?\d+(\.\d+)?$"), shown).when((F.abs(typed) >= 1e15) & (large.cast("double") == typed), large.cast("string"))
            else:
                number = texts if name == "string" else typed.cast("string")
            fits = F.coalesce(numbers.fits_decimal(number), F.lit(False))
            if name == "string":
                errors.append((held & number.isNull(), f" is not a valid number for culture '{where.name}'."))
            if name != "exact":
                errors.append((held & ~fits, " is outside the Decimal range."))
                value = F.when(held, variants.decimal_of(F.when(fits, number))).otherwise(value)
            continue
        if rule.type == "ConvertToInteger" and name == "exact":
            found, wrong = numbers.text_to_integer(typed, where)
            out = Outcome(found, "bigint", wrong[1:], subject="The convert to integer transformation field")
        else:
            # what is written for one type is enough here: types that a rule does not know are errors of the row
            out = transform(rule, F.when(held, typed), name, options, 0, keep)
        subject = out.subject or subject
        errors += [(held & F.coalesce(bad, F.lit(False)), m) for bad, m in out.errors]
        if out.drop is not None:
            drops.append(held & F.coalesce(out.drop, F.lit(False)))
        elif out.value is not c and not (out.kind == name and out.kind == "exact"):
            value = F.when(held, out.value.cast("variant")).otherwise(value)
    drop = F.lit(False)
    for d in drops:
        drop = drop | d
    return Outcome(value, "variant", errors, drop if drops else None, subject)


def transform(rule: Transformation, c: Column, kind: str, options: SourceOptions, scale: int, keep: Callable[[Column], Column]) -> Outcome:
    """The outcome of a rule other than Deduplicate on a column of the given type.

    keep makes a column of its own of an expression that value and errors share, so that it is computed once.
    """
    if kind == "variant":
        return _of_own_type(rule, c, options, keep)
    where = locale(options.culture)
    config = {k: v for k, v in rule.config.items()}
    is_text = kind == "string"
    match rule.type:
        case "Trim":
            return Outcome(text.trim(c) if is_text else c, kind)
        case "ToUpper":
            return Outcome(text.to_upper(c) if is_text else c, kind)
        case "ToLower":
            return Outcome(text.to_lower(c) if is_text else c, kind)
        case "FindAndReplace":
            return Outcome(text.find_and_replace(c, str(config["Find"]), str(config["Replace"])) if is_text else c, kind)
        case "SetDefaultValue":
            value = str(config["Value"])
            return Outcome(text.default_value(c, F.lit(value) if is_text else constant(value, kind), is_text), kind)
        case "FilterRow":
            return filter_row(c, kind, str(config["Operator"]), str(config["Value"]), where, options.date_format)
        case "ConvertToString":
            shown = to_text(c, kind)
            return Outcome(shown, "string") if shown is not None else _unsupported(c, kind, "The convert to string transformation field")
        case "ConvertToInteger":
            subject = "The convert to integer transformation field"
            if is_text:
                value, errors = numbers.text_to_integer(keep(numbers.normal_text(c, where)), where, keep)
            elif kind in INTEGRAL:
                value, errors = c.cast("bigint"), []
            elif is_decimal(kind) or kind in ("double", "float"):
                value, errors = numbers.number_to_integer(c, kind)
            else:
                return _unsupported(c, kind, subject)
            return Outcome(value, "bigint", [(c.isNotNull() & bad, m) for bad, m in errors], subject=subject)
        case "ConvertToDecimal":
            subject = "The convert to decimal transformation field"
            if is_text:
                value, errors = numbers.text_to_decimal(keep(numbers.normal_text(c, where)), where, scale, keep)
            elif kind in INTEGRAL or is_decimal(kind) or kind in ("double", "float"):
                value, errors = numbers.number_to_decimal(c, kind, scale)
            else:
                return _unsupported(c, kind, subject)
            return Outcome(value, f"decimal(38,{scale})", [(c.isNotNull() & bad, m) for bad, m in errors], subject=subject)
        case "ConvertToDate":
            subject = "The convert to date transformation field"
            if kind in ("timestamp_ntz", "date", "timestamp"):
                return Outcome(c.cast("timestamp_ntz"), "timestamp_ntz")
            if not is_text:
                return _unsupported(c, kind, subject)
            value = keep(dates.date_of(c, options.date_format, where, keep))
            errors = dates.errors_of(c, value, options.date_format, where)
            return Outcome(value, "timestamp_ntz", [(c.isNotNull() & bad, m) for bad, m in errors], subject=subject)
    raise ValueError(f"The transformation type '{rule.type}' is not supported.")
