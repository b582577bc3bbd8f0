"""Exact numbers from text in a culture's notation."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.functions.locales import Locale

#: The greatest significand of a 96-bit decimal, and its greatest scale.
SIGNIFICAND, SCALE = 79228162514264337593543950335, 28
INT64 = (-(2**63), 2**63 - 1)


def pattern(locale: Locale) -> str:
    """Outer spaces, one sign at either end, digits with group separators anywhere before the decimal separator."""
    d, g = re.escape(locale.decimal), re.escape(locale.group)
    digits = rf"(?:\d[\d{g}]*(?:{d}\d*)?|{d}\d+)"
    s = r"[ \t-\r]*"
    return rf"^{s}(?:[+-]{s}{digits}|{digits}{s}[+-]?){s}$"


#: Numbers that are their own normal text, and short enough for 64 bits and a decimal.
PLAIN, PLAIN_POINT = r"^-?(?:0|[1-9][0-9]{0,17})$", r"^-?(?:0|[1-9][0-9]{0,17})(?:\.[0-9]{0,8}[1-9])?$"
#: Characters of a normal text that is surely in range.
SHORT = 28


def normal_text(c: Column, locale: Locale) -> Column:
    """The number as plain text (sign, digits, point, digits without trailing zeros), null if it is none."""
    return F.when(c.rlike(PLAIN_POINT if locale.decimal == "." else PLAIN), c).otherwise(_normalised(c, locale))


def _normalised(c: Column, locale: Locale) -> Column:
    body = F.replace(F.regexp_replace(c, r"[ \t-\r+-]", ""), F.lit(locale.group), F.lit(""))
    body = body if locale.decimal == "." else F.replace(body, F.lit(locale.decimal), F.lit("."))
    body = F.regexp_replace(F.regexp_replace(body, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"^0+(?=\d)", ""), r"^(?=\.|$)", "0")
    return F.when(c.rlike(pattern(locale)), F.concat(F.when(F.contains(c, F.lit("-")), "-").otherwise(""), body))


def fraction_length(number: Column) -> Column:
    return F.when(F.contains(number, F.lit(".")), F.char_length(number) - F.instr(number, ".")).otherwise(0)


def fits_decimal(number: Column) -> Column:
    """Whether a normal_text has at most 28 fraction digits and a significand of 96 bits."""
    digits = F.regexp_replace(number, r"[-.]", "")
    digits = F.regexp_replace(digits, r"^0+(?=\d)", "")
    limit = str(SIGNIFICAND)
    n = F.char_length(digits)
    return (F.char_length(number) <= SHORT) | (fraction_length(number) <= SCALE) & ((n < len(limit)) | ((n == len(limit)) & (digits <= limit)))


def parse(text: str, locale: Locale) -> Decimal:
    """The same for a constant; ValueError if it is no number or does not fit."""
    if not re.match(pattern(locale), text or "", re.ASCII):
        raise ValueError(f"'{text}' is not a valid number for culture '{locale.name}'.")
    body = re.sub(r"[ \t-\r+-]", "", text).replace(locale.group, "").replace(locale.decimal, ".")
    number = Decimal(("-" if "-" in text else "") + body)
    sign, digits, exponent = number.as_tuple()
    while exponent < 0 and digits[-1] == 0 and len(digits) > 1:
        digits, exponent = digits[:-1], exponent + 1
    number = Decimal((sign, digits, exponent))
    if -exponent > SCALE or abs(int("".join(map(str, digits)))) > SIGNIFICAND:
        raise OverflowError(f"'{text}' is outside the Decimal range.")
    return number


def _same(c: Column) -> Column:
    return c


def text_to_integer(number: Column, locale: Locale, keep: Callable[[Column], Column] = _same) -> tuple[Column, list[tuple[Column, str]]]:
    """BIGINT value of a normal_text, and (condition, message ending) of the errors, first match first."""
    whole = ~F.contains(number, F.lit("."))
    value = keep(F.when(whole, number.try_cast("bigint")))
    errors = [
        (number.isNull(), f" is not a valid number for culture '{locale.name}'."),
        # a number beyond 96 bits is refused before it is looked at as a whole one
        (~_in_range(number), " is outside the supported numeric range."),
        (~whole, " must contain a mathematically integral value."),
        (value.isNull(), " is outside the Int64 range."),
    ]
    return value, errors


def _in_range(number: Column) -> Column:
    """Whether the integral part is at most that of a 96-bit decimal."""
    whole = F.regexp_replace(F.regexp_replace(number, r"^-|\..*$", ""), r"^-", "")
    limit = str(SIGNIFICAND)
    n = F.char_length(whole)
    return (F.char_length(number) <= SHORT) | (n < len(limit)) | ((n == len(limit)) & (whole <= limit))


def text_to_decimal(number: Column, locale: Locale, scale: int, keep: Callable[[Column], Column] = _same) -> tuple[Column, list[tuple[Column, str]]]:
    """DECIMAL(38, scale) value of a normal_text, and errors. A number with more fraction digits than scale is an error, not rounded."""
    value = keep(F.when(fits_decimal(number) & (fraction_length(number) <= scale), number.try_cast(f"decimal(38,{scale})")))
    return value, [(number.isNull(), f" is not a valid number for culture '{locale.name}'."), (value.isNull(), " is outside the Decimal range.")]


def number_to_integer(c: Column, kind: str) -> tuple[Column, list[tuple[Column, str]]]:
    """Whole decimals and doubles to BIGINT."""
    floating = kind in ("double", "float")
    finite = ~F.isnan(c) & (F.abs(c) != float("inf")) if floating else F.lit(True)
    whole = F.when(finite, F.floor(c) == c if not floating else F.rint(c) == c)
    inside = (c >= -9.223372036854775808e18) & (c < 9.223372036854775808e18) if floating else F.lit(True)
    value = F.when(finite & whole & inside, c.try_cast("bigint"))
    return value, [(~finite | ~whole, " must contain a mathematically integral value."), (value.isNull(), " is outside the Int64 range.")]


def number_to_decimal(c: Column, kind: str, scale: int) -> tuple[Column, list[tuple[Column, str]]]:
    if kind in ("double", "float"):
        finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
        value = F.when(finite, c.try_cast(f"decimal(38,{scale})"))
        value = F.when(value.cast(kind) == c, value)
    else:
        value = c.try_cast(f"decimal(38,{scale})")
        value = F.when(value == c, value)
    return value, [(value.isNull(), " is outside the Decimal range.")]
