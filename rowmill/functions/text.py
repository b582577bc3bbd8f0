"""Text functions with one-to-one casing, all Unicode white space, and lengths in UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: separators, and the control characters that count as space.
SPACE = r"[\p{Z}\t-\r\x85]"
#: Characters whose upper or lower case is not one character, or differs from the invariant one; they stay as they are.
SPECIAL = r"[ßŉǰΐΰևẖ-ẚẞἀ-῿ﬀ-ﬗİı]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return c.rlike(rf"^{SPACE}*$")


def has_value(c: Column, is_text: bool) -> Column:
    """Neither null nor, for text, blank."""
    return c.isNotNull() & ~is_blank(c) if is_text else c.isNotNull()


def _cased(c: Column, case) -> Column:
    # ordinary text is cased as a whole; only text with special characters goes character by character
    each = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(SPECIAL) | (F.char_length(case(x)) != 1), x).otherwise(case(x))), "")
    return F.when(c.rlike(SPECIAL), each).otherwise(case(c))


def to_upper(c: Column) -> Column:
    return _cased(c, F.upper)


def to_lower(c: Column) -> Column:
    return _cased(c, F.lower)


def utf16(c: Column) -> Column:
    """Bytes whose order is that of UTF-16 units."""
    return F.encode(c, "UTF-16BE")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(utf16(c)) / 2).cast("long")


def find_and_replace(c: Column, find: str, replace: str) -> Column:
    return F.replace(c, F.lit(find), F.lit(replace))


def default_value(c: Column, value: Column, is_text: bool) -> Column:
    """value for null and, in text, for the empty text; blanks stay."""
    missing = c.isNull() | (c == "") if is_text else c.isNull()
    return F.when(missing, value).otherwise(c)


def is_email(c: Column) -> Column:
    """Exactly one @, neither first nor last, and no line break."""
    return (F.char_length(c) - F.char_length(F.replace(c, F.lit("@"), F.lit(""))) == 1) & ~F.startswith(c, F.lit("@")) & ~F.endswith(c, F.lit("@")) & ~c.rlike(r"[\r\n]")
