"""Operators one by one, on literal values."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowmill.functions import dates, numbers, text
from rowmill.functions.locales import locale
from rowmill.plans.compiler import compile_rows
from rowmill.plans.spec import FieldMapping, Pipeline, SourceOptions, Transformation, Validation


def run(spark, values, rules=(), validations=(), kind="string", culture="en-US", date_format=None, scale=10):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"n long, v {kind}")
    pipeline = Pipeline("t", (("n", "Integer"), ("v", "String")), (FieldMapping("n", "n"), FieldMapping("v", "v")), "n", tuple(rules), tuple(validations), SourceOptions(culture, date_format), scale)
    return [(r["_status"], r["v"], [e["message"] for e in r["_errors"]]) for r in compile_rows(df, pipeline, "n").orderBy("_row_number").collect()]


def values(rows):
    return [v if s == "Valid" else s for s, v, _ in rows]


def test_trim_takes_all_unicode_space(spark):
    rows = run(spark, ["  a b ", " x ", "\t\r\ny\x85", "", None, "   "], [Transformation("Trim", 1, "v")])
    assert values(rows) == ["a b", "x", "y", "", None, ""]


def test_casing_is_one_to_one(spark):
    assert values(run(spark, ["straße ﬁ é", "abc"], [Transformation("ToUpper", 1, "v")])) == ["STRAßE ﬁ É", "ABC"]
    assert values(run(spark, ["ÀB", "İ"], [Transformation("ToLower", 1, "v")])) == ["àb", "İ"]


@pytest.mark.parametrize(
    "value, expected",
    [("1,234.00", 1234), (" 28 ", 28), ("5-", -5), ("+7", 7), ("-0", 0), ("1.5", "Invalid"), ("1E3", "Invalid"), ("", "Invalid"), ("(5)", "Invalid"), ("$5", "Invalid"), ("-5-", "Invalid"), (".5", "Invalid"), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", "Invalid"), (None, None), ("007", 7)],
)
def test_convert_to_integer(spark, value, expected):
    assert values(run(spark, [value], [Transformation("ConvertToInteger", 1, "v")])) == [expected]


def test_integer_errors_say_why(spark):
    rows = run(spark, ["x", "1.5", "9223372036854775808", "9" * 40], [Transformation("ConvertToInteger", 1, "v")])
    lead = "The convert to integer transformation field 'v' in row "
    assert [m for _, _, (m,) in rows] == [
        lead + "0 is not a valid number for culture 'en-US'.",
        lead + "1 must contain a mathematically integral value.",
        lead + "2 is outside the Int64 range.",
        lead + "3 is outside the supported numeric range.",
    ]


def test_convert_to_decimal_is_exact(spark):
    rows = run(spark, ["1,25", "1.234,50", "0,123", "x"], [Transformation("ConvertToDecimal", 1, "v")], culture="de-DE", scale=2)
    assert values(rows) == [Decimal("1.25"), Decimal("1234.50"), "Invalid", "Invalid"]


def test_doubles_convert_only_when_whole_and_finite(spark):
    rows = run(spark, [5.0, 5.5, float("inf"), float("nan"), None, 1e19], [Transformation("ConvertToInteger", 1, "v")], kind="double")
    assert values(rows) == [5, "Invalid", "Invalid", "Invalid", None, "Invalid"]


def test_convert_to_string(spark):
    rule = [Transformation("ConvertToString", 1, "v")]
    assert values(run(spark, [True, False, None], rule, kind="boolean")) == ["True", "False", None]
    assert values(run(spark, [5.0, 1e20, 0.5, 123456789.25, 1e-7], rule, kind="double")) == ["5", "1E+20", "0.5", "123456789.25", "1E-07"]
    assert values(run(spark, [Decimal("1.50")], rule, kind="decimal(10,2)")) == ["1.5"]


@pytest.mark.parametrize("fmt, value, expected", [("yyyy-MM-dd", "1998-04-12", (1998, 4, 12)), ("yyyy-MM-dd", " 1998-04-12 ", (1998, 4, 12)), ("yyyy-MM-dd", "1998-4-12", None), ("dd/MM/yyyy", "31/12/2020", (2020, 12, 31)), ("d MMM yyyy", "5 Jan 2021", (2021, 1, 5)), (None, "4/12/1998", (1998, 4, 12)), (None, "1998-04-12", (1998, 4, 12)), (None, "12", None)])
def test_convert_to_date(spark, fmt, value, expected):
    got = values(run(spark, [value], [Transformation("ConvertToDate", 1, "v")], date_format=fmt))
    assert got == [datetime.datetime(*expected) if expected else "Invalid"]


CULTURE_DATES = [
    (None, "de-DE", "12. März 1998", (1998, 3, 12)),
    (None, "fr-FR", "12 mars 1998 17:05", (1998, 3, 12, 17, 5)),
    (None, "tr-TR", "12 Nisan 1998", (1998, 4, 12)),
    (None, "en-US", "March 9, 2026", (2026, 3, 9)),
    (None, "en-US", "Monday, March 9, 2026 3:05 PM", (2026, 3, 9, 15, 5)),
    (None, "tr-TR", "March 9, 2026", None),
    (None, "tr-TR", "30/02/2026", None),
    ("dd MMMM yyyy", "tr-TR", "31 Aralık 2026", (2026, 12, 31)),
    ("dd MMMM yyyy", "tr-TR", "31 ARALIK 2026", (2026, 12, 31)),
    ("dd MMM yyyy", "fr-FR", "12 févr. 1998", (1998, 2, 12)),
    ("d", "tr-TR", "31.12.2026", (2026, 12, 31)),
    ("g", "en-US", "12/31/2026 3:05 PM", (2026, 12, 31, 15, 5)),
    ("D", "en-US", "Thursday, December 31, 2026", (2026, 12, 31)),
    ("MM/dd/y", "en-US", "12/31/6", (2006, 12, 31)),
    ("MM/dd/yy", "en-US", "12/31/26", (2026, 12, 31)),
    ("MM/dd/yy", "en-US", "12/04/75", (1975, 12, 4)),
    ("MM/dd/yyy", "en-US", "12/31/026", (26, 12, 31)),
    ("MM/dd/yyyyy", "en-US", "12/31/02026", (2026, 12, 31)),
]


@pytest.mark.parametrize("fmt, culture, value, expected", CULTURE_DATES)
def test_dates_of_cultures_and_formats(spark, fmt, culture, value, expected):
    got = values(run(spark, [value], [Transformation("ConvertToDate", 1, "v")], culture=culture, date_format=fmt))
    assert got == [datetime.datetime(*expected) if expected else "Invalid"]
    if expected:
        assert dates.parse(value, fmt, locale(culture)) == datetime.datetime(*expected)
    else:
        with pytest.raises(ValueError):
            dates.parse(value, fmt, locale(culture))


@pytest.mark.parametrize("bounds", [{"Minimum": "soon"}, {"Minimum": "2026-01-02", "Maximum": "2026-01-01"}, {"Maximum": " "}])
def test_date_ranges_need_good_bounds(spark, bounds):
    with pytest.raises(ValueError):
        run(spark, [datetime.datetime(2026, 1, 1)], (), [Validation("DateRange", "v", bounds)], kind="timestamp_ntz", date_format="yyyy-MM-dd")


def test_date_formats_need_a_year_and_no_zone():
    with pytest.raises(ValueError):
        dates.java_pattern("dd/MM")
    with pytest.raises(ValueError):
        dates.java_pattern("yyyy-MM-dd zzz")
    assert dates.java_pattern("yyyy'T'MM tt") == "yyyy'T'MM a"


def test_default_value_leaves_blanks(spark):
    assert values(run(spark, [None, "", " ", "x"], [Transformation("SetDefaultValue", 1, "v", {"Value": "d"})])) == ["d", "d", " ", "x"]


def test_find_and_replace_is_no_pattern(spark):
    assert values(run(spark, ["a.b.c", None], [Transformation("FindAndReplace", 1, "v", {"Find": ".", "Replace": ""})])) == ["abc", None]


def test_filter_row(spark):
    def rule(op, value):
        return [Transformation("FilterRow", 1, "v", {"Operator": op, "Value": value})]

    assert values(run(spark, ["a", "b", None, ""], rule("NotEquals", "a"))) == ["a", "Filtered", None, "Filtered"]
    assert values(run(spark, [1, 5, None], rule("GreaterThan", "1,0.0"), kind="bigint")) == [1, 5, None]
    assert [s for s, _, _ in run(spark, [1, None], rule("Equals", "x"), kind="bigint")] == ["Invalid", "Valid"]
    # by UTF-16 units, an astral character is below U+FFFD
    assert values(run(spark, ["😀"], rule("LessThan", "�"))) == ["Filtered"]
    # a 32-bit column is refused until it is converted
    assert [s for s, _, _ in run(spark, [1], rule("Equals", "1"), kind="int")] == ["Invalid"]


def test_validations(spark):
    def status(value, rule, kind="string"):
        return run(spark, [value], (), [rule], kind=kind)[0][0]

    email = Validation("EmailFormat", "v")
    assert [status(v, email) for v in ("a@b", " a@b ", "a", "@b", "a@", "a@b@c", "a@b\n", None, " ")] == ["Valid", "Valid", "Invalid", "Invalid", "Invalid", "Invalid", "Invalid", "Valid", "Valid"]
    length = Validation("TextLengthRange", "v", {"Minimum": "3", "Maximum": "3"})
    assert [status(v, length) for v in ("abc", "😀a", "ab")] == ["Valid", "Valid", "Invalid"]
    number = Validation("NumericRange", "v", {"Minimum": "18"}, "too young")
    assert run(spark, [17], (), [number], kind="bigint")[0][2] == ["too young"]
    assert status(1.5, number, "double") == "Invalid"
    assert run(spark, [None, " "], (), [Validation("Required", "v")])[1][2] == ["Field 'v' is required."]


def test_all_errors_of_a_row_are_kept_in_order(spark):
    rules = [Validation("EmailFormat", "v"), Validation("TextLengthRange", "v", {"Maximum": "2"})]
    assert run(spark, ["abc"], (), rules)[0][2] == ["Field 'v' must be a valid email address.", "Field 'v' must be at most 2 characters."]


def test_numbers_as_text(spark):
    df = spark.createDataFrame([("+1,0.50",), ("0.0",), ("-.5",), ("12.",)], "v string")
    assert [r[0] for r in df.select(numbers.normal_text(F.col("v"), locale("en-US"))).collect()] == ["10.5", "0", "-0.5", "12"]
    assert numbers.parse("1,234.50", locale("en-US")) == Decimal("1234.5")


def test_text_length_counts_utf16_units(spark):
    assert spark.range(1).select(text.utf16_length(F.lit("😀a"))).first()[0] == 3


def test_unknown_cultures_are_refused():
    with pytest.raises(ValueError):
        SourceOptions("xx-XX")
