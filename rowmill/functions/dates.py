"""Dates from text: .NET-style format strings as Java patterns, and the patterns of a culture."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.functions.locales import Locale, days_of

_TOKEN = re.compile(r"\\.|'[^']*'|\"[^\"]*\"|d{1,4}|M{1,4}|y{1,5}|h{1,2}|H{1,2}|m{1,2}|s{1,2}|f{1,7}|F{1,7}|t{1,2}|z{1,3}|K|[^A-Za-z]|[A-Za-z]")
#: Format tokens, their Java forms, and patterns of the text they take.
_JAVA = {"d": "d", "dd": "dd", "M": "M", "MM": "MM", "y": "y", "yy": "yy", "yyy": "yyy", "yyyy": "yyyy", "yyyyy": "yyyyy", "h": "h", "hh": "hh", "H": "H", "HH": "HH", "m": "m", "mm": "mm", "s": "s", "ss": "ss", "tt": "a"}
_DIGITS = {"d": r"\d\d?", "M": r"\d\d?", "y": r"\d\d?", "yyy": r"\d{3,5}", "h": r"\d\d?", "H": r"\d\d?", "m": r"\d\d?", "s": r"\d\d?"}
_FIELD = {"d": "day", "M": "month", "y": "year", "h": "half_hour", "H": "hour", "m": "minute", "s": "second"}
#: Month names stand in these marks, as two digits.
_OPEN, _CLOSE = "\u2039", "\u203a"
#: What stands for the name of a weekday, which is taken out of the text and held against the date.
_DAY = "\u2020"
#: The Java pattern of dates brought into one order; a day that is not named is the first. Six fraction digits take fewer, too.
_ORDERED = f"{_OPEN}yyyy-M-[d]{_CLOSE}[ h:mm[:ss] a][ H:mm[:ss[.SSSSSS]]]"
#: The greatest year that two digits stand for; greater ones are of the century before.
LAST_SHORT_YEAR = 2049


@dataclass(frozen=True)
class Format:
    """A date format as a Java pattern, and as a regular expression for constants; whether it names months, and has years of one or two digits."""

    java: str
    pattern: str
    named: bool
    short_year: bool
    #: Where the names of weekdays stand: none, full (dddd) or short (ddd) ones.
    weekday: str = ""


def format_of(date_format: str) -> Format:
    """A custom format. It must hold a year and no zone."""
    java, pattern = [], []
    year = named = short = False
    weekday = ""

    def literal(text: str) -> None:
        java.append("".join(f"'{x}'" if x.isalpha() or x in "[]{}#" else "''" if x == "'" else x for x in text))
        pattern.append(re.escape(text))

    for token in _TOKEN.findall(date_format.lstrip("%") if len(date_format) == 2 else date_format):
        if token[0] == "\\":
            literal(token[1])
        elif token[0] in "'\"":
            literal(token[1:-1])
        elif token[0] in "zK":
            raise ValueError(f"The date format '{date_format}' must not contain a timezone or offset.")
        elif token[0] in "fF":
            digits = min(len(token), 6)  # a seventh digit is cut off before
            java.append("S" * digits if token[0] == "f" else "[" + "S" * digits + "]")
            pattern.append(r"(?P<fraction>\d{%d})" % digits if token[0] == "f" else r"(?P<fraction>\d{0,%d})" % digits)
        elif token in ("MMM", "MMMM"):
            named = True
            java.append(f"{_OPEN}MM{_CLOSE}")
            pattern.append(rf"{_OPEN}(?P<month>\d\d){_CLOSE}")
        elif token in ("ddd", "dddd"):
            weekday = token
            java.append(_DAY)
            pattern.append(_DAY)
        elif token == "tt":
            java.append("a")
            pattern.append("(?P<half>[aApP])[mM]")
        elif token in _JAVA:
            if token[0] == "y":
                year, short = True, len(token) < 3
            java.append(_JAVA[token])
            pattern.append(f"(?P<{_FIELD[token[0]]}>{_DIGITS.get(token) or rf'\d{{{len(token)}}}'})")
        elif token.isalpha():
            raise ValueError(f"The date format '{date_format}' contains '{token}', which is not supported.")
        else:
            literal(token)
    if not year:
        raise ValueError(f"The date format '{date_format}' must contain a year.")
    return Format("".join(java), "".join(pattern), named, short, weekday)


def java_pattern(date_format: str) -> str:
    return format_of(date_format).java


def formats_of(date_format: str, locale: Locale) -> list[Format]:
    """The formats that a custom format, or a standard one of a single letter, stands for in a culture."""
    if len(date_format) > 1:
        return [format_of(date_format)]
    if date_format in "rRu":
        raise ValueError(f"The date format '{date_format}' must not contain a timezone or offset.")
    short, long = [locale.dates[0]], [d for d in locale.dates if "MMMM" in d and "d" in d]
    times, seconds = ["H:mm", *(t for t in locale.times if "s" not in t)], ["H:mm:ss", *(t for t in locale.times if "s" in t)]
    both = lambda dates, times: [f"{d} {t}" for d in dates for t in times]
    known = {
        "d": short, "D": long, "f": both(long, times), "F": both(long, seconds), "g": both(short, times), "G": both(short, seconds),
        "y": [d for d in locale.dates if "d" not in d], "Y": [d for d in locale.dates if "d" not in d], "s": ["yyyy-MM-dd'T'HH:mm:ss"],
    }
    if date_format not in known:
        raise ValueError(f"The date format '{date_format}' must contain a year.")
    return [format_of(_loose(x)) for x in known[date_format]]


def _loose(pattern: str) -> str:
    """Days and months with or without leading zeros."""
    return re.sub(r"(?<!M)MM(?!M)", "M", re.sub(r"(?<!d)dd(?!d)", "d", pattern))


def culture_formats(locale: Locale) -> list[Format]:
    """Formats of a culture with other separators, each alone and with times of day."""
    dates = []
    for p in map(_loose, locale.dates):
        for sep in ("/", ".", "-") if re.fullmatch(r"[dMy]+([/.-])[dMy]+\1[dMy]+", p) else ("",):
            dates.append(re.sub(r"[/.-]", sep, p) if sep else p)
    times = ["H:mm", "H:mm:ss", *("H:mm:ss." + "f" * n for n in range(6, 0, -1)), *locale.times]
    return [format_of(x) for x in [*dict.fromkeys(dates), *(f"{d} {t}" for d in dict.fromkeys(dates) for t in times)]]


#: An offset or a zone behind a time, or a Z.
ZONE = r"\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)\s*$"


def _names(locale: Locale) -> tuple[str, dict[str, str]]:
    """A pattern of the culture's month names in lower case, and the mark of each."""
    marks: dict[str, str] = {}
    for names in locale.months:
        for i, name in enumerate(names, 1):
            for form in (name.lower(), name.upper().lower()):
                marks.setdefault(form, f"{_OPEN}{i:02d}{_CLOSE}")
    longest = sorted(marks, key=lambda n: (-len(n), n))
    return r"(?<!\p{L})(?=\p{L})(" + "|".join(map(re.escape, longest)) + r")(?!\p{L})", marks


def _weekday(locale: Locale) -> str:
    """A word in front of a date that is no month."""
    months = _names(locale)[0].removeprefix(r"(?<!\p{L})")
    return rf"(?i)^(?!{months})\p{{L}}+,?\s+(?=\d|\p{{L}}+\s+\d+,)"


def _days(locale: Locale, weekday: str) -> tuple[str, dict[str, int]]:
    """A pattern of the culture's full or short names of weekdays in lower case, and the number of each, Sunday 1."""
    numbers = {name.lower(): i for i, name in enumerate(days_of(locale)[0 if weekday == "dddd" else 1], 1)}
    return r"(?<!\p{L})(" + "|".join(map(re.escape, sorted(numbers, key=lambda n: (-len(n), n)))) + r")(?!\p{L})", numbers


def _without_weekday(text: Column, f: Format, locale: Locale) -> tuple[Column, Column]:
    """A text with a mark in the place of its weekday's name, and the day that the name stands for."""
    pattern, numbers = _days(locale, f.weekday)
    found = F.regexp_extract(F.lower(text), pattern, 1)
    day = F.element_at(F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair)), found)
    return F.regexp_replace(F.lower(text), pattern, _DAY), day


def _same(c: Column) -> Column:
    return c


def date_of(c: Column, date_format: str | None, locale: Locale, keep: Callable[[Column], Column] = _same) -> Column:
    """TIMESTAMP_NTZ value, null if the text is no date. The session's time zone must be UTC, else hours that a change of clocks skips would move.

    keep makes a column of its own of an expression that many formats share, so that it is computed once.
    """
    # fraction digits: microseconds are kept, a seventh digit (100 nanoseconds) is cut off
    text = keep(F.trim(c, F.lit(" \t\r\n")))
    text = keep(F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"(\.\d{6})(?:\d|0+)(?=\D|$)", "$1")).otherwise(text))
    formats = formats_of(date_format, locale) if date_format else culture_formats(locale)
    if not date_format or date_format in "DfF":  # a weekday may stand in front; it is not checked against the date
        # most texts begin and end with a digit, so they need no look
        text = keep(F.when(F.ascii(text) > ord("9"), F.regexp_replace(text, _weekday(locale), "")).otherwise(text))
        last = rf"(?i),?[ ]+(?:{'|'.join(map(re.escape, days_of(locale)[0]))})$"
        text = F.when(F.ascii(F.right(text, F.lit(1))) > ord("9"), F.regexp_replace(text, last, "")).otherwise(text)
    if any(f.weekday for f in formats):
        # a custom format with the name of a weekday, which must be that of the date
        (own,) = formats
        text, day = _without_weekday(text, own, locale)
        value = _of_formats(text, formats, locale, keep)
        return F.when(F.dayofweek(value) == day, value)
    return _of_formats(text, formats, locale, keep)


def _of_formats(text: Column, formats: list[Format], locale: Locale, keep: Callable[[Column], Column]) -> Column:
    """The value by the first format that takes the text. Of several, none is tried on a text that doesn't look like it, as each that fails costs an exception."""
    formats = sorted(formats, key=lambda f: f.named)
    rewrites = _rewrites(formats)
    marked = None
    text = keep(text)
    if formats[-1].named:
        pattern, marks = _names(locale)
        low = keep(F.lower(text))
        name = keep(F.regexp_extract(low, pattern, 1))
        mark = F.element_at(F.create_map(*(F.lit(x) for pair in marks.items() for x in pair)), name)
        # what is rewritten holds no other letters than AM and PM, so the name stands nowhere else in it
        marked = F.when(name != "", F.replace(low, name, mark) if rewrites else F.regexp_replace(low, F.lit(pattern), mark))
    if len(formats) == 1 or not rewrites:
        return F.coalesce(*(_parsed(marked if f.named else text, f) for f in formats))
    # all formats are written as one that is parsed: a branch for each makes a method that the JVM does not compile
    given = text if marked is None else keep(F.coalesce(marked, F.when(~F.contains(low, F.lit(_OPEN)), low)))
    found = []
    for pattern, order in rewrites:
        ordered = keep(F.regexp_replace(given, pattern, order))
        found.append(F.when(ordered != given, F.try_to_timestamp(ordered, F.lit(_ORDERED)).cast("timestamp_ntz")))
    return F.coalesce(*found)


def _rewrites(formats: list[Format]) -> list[tuple[str, str]]:
    """Patterns, and what to put in their places, that bring texts of the formats into the order of _ORDERED; none if a format can't be brought into it.

    Dates that differ in their order alone (M/d/yyyy and yyyy/M/d) are in patterns of their own, to be tried one after the other.
    """
    times: dict[str, set[str]] = {}
    for f in formats:
        date, time = re.fullmatch(r"(.*?)( H:mm(?::ss(?:\.S+)?)?| h:mm(?::ss)? a)?", f.java).groups(default="")
        times.setdefault(date, set()).add(re.sub("S+", "S", time))
        if not re.fullmatch(rf"(?:(?:yyyy|{_OPEN}MM{_CLOSE}|[dM])(?!\w)|[ ,./-])+", date) or any(date.count(x) > 1 for x in ("yyyy", "d", "MM")) or len(re.findall("M+", date)) != 1:
            return []
    (one, *others) = times.values()
    if any(other != one for other in others):
        return []
    ends = "|".join(sorted(re.sub("[hHmsS]+", "[0-9]+", re.escape(t)).replace("a", "(?i:[ap]m)") for t in one))
    ranks: list[list[str]] = []
    shapes: list[str] = []
    for date in times:
        shapes.append(re.sub(r"\w+", "0", date))
        rank = shapes.count(shapes[-1]) - 1
        ranks[rank:] = [(ranks[rank] if rank < len(ranks) else []) + [date], *ranks[rank + 1 :]]
    out = []
    for dates in ranks:
        groups: dict[str, str] = {"y": "", "M": "", "d": ""}
        patterns = []
        for token in re.findall(r"\w+|\W", "|".join(dates)):
            if token[0] in groups:
                groups[token[0]] += f"${sum(g.count('$') for g in groups.values()) + 1}"
                patterns.append({"yyyy": "([+-]?[0-9]+)", "MM": "([0-9]{2})"}.get(token, "([0-9]+)"))
            else:
                patterns.append(token if token == "|" else re.escape(token))
        out.append((f"^(?:{''.join(patterns)})(?=(?:{ends})$)", f"{_OPEN}{groups['y']}-{groups['M']}-{groups['d']}{_CLOSE}"))
    return out


def _parsed(text: Column, f: Format) -> Column:
    value = F.try_to_timestamp(text, F.lit(f.java)).cast("timestamp_ntz")
    if not f.short_year:
        return value
    # two digits are read as 2000 to 2099, and one as a year of the first century
    year = F.year(value)
    century = F.when(year < 10, 2000).when(year > LAST_SHORT_YEAR, -100).otherwise(0)
    return F.when((year < 10) | (year >= 2000) & (year < 2100), value + F.make_ym_interval(century))


def parse(text: str, date_format: str | None, locale: Locale) -> datetime.datetime:
    """The same for a constant; ValueError if it is no date."""
    given = re.sub(r"(\.\d{6})(?:\d|0+)(?=\D|$)", r"\1", text.strip(" \t\r\n"))
    if not date_format or date_format in "DfF":
        given = re.sub(_weekday(locale).replace(r"\p{L}", r"[^\W\d_]"), "", given)
        given = re.sub(rf"(?i),?[ ]+(?:{'|'.join(map(re.escape, days_of(locale)[0]))})$", "", given)
    formats = formats_of(date_format, locale) if date_format else culture_formats(locale)
    day = None
    if any(f.weekday for f in formats):
        days, numbers = _days(locale, formats[0].weekday)
        days = days.replace(r"\p{L}", r"[^\W\d_]")
        if (name := re.search(days, given.lower())) is not None:
            day, given = numbers[name[1]], re.sub(days, _DAY, given.lower())
    pattern, marks = _names(locale)
    marked = re.sub(pattern.replace(r"\p{L}", r"[^\W\d_]"), lambda m: marks[m[1]], given.lower())
    for f in formats:
        m = re.fullmatch(f.pattern, marked if f.named else given)
        if m is None:
            continue
        got = m.groupdict()
        year = int(got["year"])
        if f.short_year:
            year += 2000 if 2000 + year <= LAST_SHORT_YEAR else 1900
        hour = int(got.get("hour") or 0)
        if got.get("half_hour"):
            hour = int(got["half_hour"]) % 12 + 12 * ((got.get("half") or "a") in "pP")
        try:
            value = datetime.datetime(year, int(got.get("month") or 1), int(got.get("day") or 1), hour, int(got.get("minute") or 0), int(got.get("second") or 0), int((got.get("fraction") or "0")[:6].ljust(6, "0")))
        except ValueError:
            continue
        if f.weekday and value.isoweekday() % 7 + 1 != day:
            continue
        return value
    raise ValueError(f"'{text}' is not a valid date for culture '{locale.name}'" + (f" and format '{date_format}'." if date_format else "."))


def errors_of(c: Column, value: Column, date_format: str | None, locale: Locale) -> list[tuple[Column, str]]:
    known = f" is not a valid date for culture '{locale.name}'" + (f" and format '{date_format}'." if date_format else ".")
    return [(value.isNull() & c.rlike(ZONE), " contains unsupported timezone or offset information."), (value.isNull(), known)]
