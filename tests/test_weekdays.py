"""Names of weekdays in dates, and fractions of seven digits."""

import datetime

import pytest
from pyspark.sql import functions as F

from rowmill.functions.dates import date_of, parse
from rowmill.functions.locales import locale

DAY = datetime.datetime(2026, 12, 31)
GOOD = [
    ("tr-TR", None, "31 Aralık 2026 Perşembe", DAY),
    ("en-US", None, "Thursday, December 31, 2026", DAY),
    ("en-US", "ddd, d MMM yyyy", "Thu, 31 Dec 2026", DAY),
    ("en-US", "dddd d/M/yyyy", "thursday 31/12/2026", DAY),
    ("de-DE", "dddd, d. MMMM yyyy", "Donnerstag, 31. Dezember 2026", DAY),
    ("fr-FR", "ddd d MMM yyyy", "jeu. 31 déc. 2026", DAY),
    ("tr-TR", "d MMMM yyyy dddd", "31 Aralık 2026 Perşembe", DAY),
    ("", "yyyy-MM-dd HH:mm:ss.fffffff", "2026-12-31 01:02:03.1234567", datetime.datetime(2026, 12, 31, 1, 2, 3, 123456)),
    ("", None, "2026-12-31 01:02:03.1234567", datetime.datetime(2026, 12, 31, 1, 2, 3, 123456)),
]
BAD = [("en-US", "ddd, d MMM yyyy", "Fri, 31 Dec 2026"), ("en-US", "ddd, d MMM yyyy", "31 Dec 2026"), ("en-US", "dddd d/M/yyyy", "Thu 31/12/2026"), ("", None, "2026-12-31 01:02:03.12345678")]


@pytest.mark.parametrize("culture, form, text, want", GOOD)
def test_dates_with_weekdays(spark, culture, form, text, want):
    assert spark.range(1).select(date_of(F.lit(text), form, locale(culture)).alias("d")).first()["d"] == want
    assert parse(text, form, locale(culture)) == want


@pytest.mark.parametrize("culture, form, text", BAD)
def test_dates_that_are_none(spark, culture, form, text):
    assert spark.range(1).select(date_of(F.lit(text), form, locale(culture)).alias("d")).first()["d"] is None
    with pytest.raises(ValueError):
        parse(text, form, locale(culture))
