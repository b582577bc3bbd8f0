"""Registered queries of the engine and the SQL they are compared with.

The tables given are clean, so dirt is made from column arithmetic by expressions that both engines read alike.
"""

from __future__ import annotations

import dataclasses
import itertools
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions.locales import LOCALES
from rowmill.operators import counters, deduplicate, inspection, schema
from rowmill.operators.mapping import apply
from rowmill.operators.transformations import to_text
from rowmill.plans import readiness
from rowmill.plans.compiler import compile_rows
from rowmill.plans.run import execute, runs
from rowmill.plans.spec import FieldMapping, Pipeline, SourceOptions, Transformation, Validation, reordered
from rowmill.plans.state import shared_folder
from rowmill.sinks.error_report import error_report
from rowmill.sinks.upsert import VersionedTable, map_columns, merged
from rowmill.sources import documents, workbook
from rowmill.sources.delimited import read_delimited
from rowmill.sources.order import gate, with_row_numbers
from rowmill.streaming.batches import progress, run_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the dirty customers, by expressions that both engines share

DIRTY = {
    "CustomerId": "CASE WHEN c_custkey % 37 = 0 THEN '' WHEN c_custkey % 10 = 3 THEN CAST(c_custkey - 1 AS VARCHAR(20)) ELSE CAST(c_custkey AS VARCHAR(20)) END",
    "FullName": "CASE WHEN c_custkey % 11 = 0 THEN '   ' WHEN c_custkey % 7 = 0 THEN '  ' || c_name || ' ' ELSE c_name END",
    "Email": "CASE WHEN c_custkey % 13 = 0 THEN c_name || '.example.com' ELSE 'User.' || CAST(c_custkey AS VARCHAR(20)) || '@Example.COM' END",
    "Age": "CASE WHEN c_custkey % 17 = 0 THEN 'abc' WHEN c_custkey % 19 = 0 THEN '200' WHEN c_custkey % 3 = 0 THEN ' ' || CAST(20 + c_custkey % 50 AS VARCHAR(20)) || '.00' ELSE CAST(20 + c_custkey % 50 AS VARCHAR(20)) END",
    "Balance": "CASE WHEN c_custkey % 23 = 0 THEN 'n/a' ELSE '1,' || CAST(100 + c_custkey % 900 AS VARCHAR(20)) || '.' || CAST(10 + c_custkey % 90 AS VARCHAR(20)) END",
    "BirthDate": "CASE WHEN c_custkey % 29 = 0 THEN 'unknown' ELSE '19' || CAST(50 + c_custkey % 50 AS VARCHAR(20)) || '-' || CAST(10 + c_custkey % 3 AS VARCHAR(20)) || '-' || CAST(10 + c_custkey % 19 AS VARCHAR(20)) END",
    "Country": "CASE WHEN c_custkey % 31 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN 'Other' ELSE 'Turkey' END",
}
FIELDS = tuple(DIRTY)
_DIRTY_SQL = "SELECT c_custkey AS n, " + ", ".join(f"{e} AS {c}" for c, e in DIRTY.items()) + " FROM customer"


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), *(F.expr(e).cast("string").alias(c) for c, e in DIRTY.items()))


#: Bad values of the dirty columns, and what repairs them.
REPAIRS = {"Age": ("abc", "41"), "Balance": ("n/a", "0.5"), "BirthDate": ("unknown", "1970-01-01")}


def repaired(*fields: str) -> dict[str, str]:
    """Expressions of all fields over dirty rows, with the bad values of some repaired."""
    return {c: f"CASE WHEN {c} = '{REPAIRS[c][0]}' THEN '{REPAIRS[c][1]}' ELSE {c} END" if c in fields else c for c in FIELDS}


def _rule(order: int, kind: str, field: str | None = None, **config) -> Transformation:
    return Transformation(kind, order, field, config)


def _pipeline(name: str, fields: tuple[str, ...], key: str, rules=(), validations=(), options=SourceOptions("en-US", "yyyy-MM-dd"), scale: int = 2) -> Pipeline:
    return Pipeline(name, tuple((f, "String") for f in fields), tuple(FieldMapping(f, f) for f in fields), key, tuple(rules), tuple(validations), options, scale)


CUSTOMERS = _pipeline(
    "customers",
    FIELDS,
    "CustomerId",
    (
        _rule(1, "FilterRow", "Country", Operator="NotEquals", Value="Turkey"),
        _rule(2, "Trim", "FullName"),
        _rule(3, "ToLower", "Email"),
        _rule(4, "ConvertToInteger", "Age"),
        _rule(5, "ConvertToDecimal", "Balance"),
        _rule(6, "ConvertToDate", "BirthDate"),
        _rule(7, "Deduplicate", Fields=["CustomerId"]),
    ),
    (Validation("Required", "FullName"), Validation("EmailFormat", "Email"), Validation("NumericRange", "Age", {"Minimum": "18", "Maximum": "100"})),
)

#: The same pipeline in SQL: outcome of each row by itself, then owners of keys, then statuses.
_OUTCOMES_SQL = f"""
WITH src AS ({_DIRTY_SQL}),
parsed AS (SELECT *, TRIM(FullName) AS name2, LOWER(Email) AS email2,
    TRY_CAST(REPLACE(TRIM(Age), '.00', '') AS BIGINT) AS age2, TRY_CAST(REPLACE(Balance, ',', '') AS DECIMAL(38,2)) AS balance2, TRY_CAST(BirthDate AS DATE) AS birth2 FROM src),
judged AS (SELECT *,
    CASE WHEN Country <> 'Turkey' THEN 'Filtered' WHEN age2 IS NULL OR balance2 IS NULL OR birth2 IS NULL THEN 'Invalid' END AS event,
    (TRIM(FullName) = '' OR LENGTH(email2) - LENGTH(REPLACE(email2, '@', '')) <> 1 OR age2 < 18 OR age2 > 100) AS broken FROM parsed),
owners AS (SELECT CustomerId AS own, MIN(n) AS owner FROM judged WHERE event IS NULL AND NOT broken AND CustomerId <> '' GROUP BY CustomerId),
final AS (SELECT j.*, CASE WHEN event IS NOT NULL THEN event WHEN owner < n THEN 'Duplicate' WHEN broken OR CustomerId = '' THEN 'Invalid' ELSE 'Valid' END AS status
    FROM judged j LEFT JOIN owners ON CustomerId = own)
"""


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_rows(dirty_customers(spark, sf_dir), CUSTOMERS, "n")


@registered(
    _OUTCOMES_SQL
    + """SELECT n, status, CustomerId AS customer_id, CASE WHEN event = 'Filtered' THEN FullName ELSE name2 END AS full_name,
    CASE WHEN event = 'Filtered' THEN Email ELSE email2 END AS email, CASE WHEN event = 'Filtered' THEN NULL ELSE age2 END AS age,
    CASE WHEN event = 'Filtered' OR age2 IS NULL THEN NULL ELSE CAST(balance2 AS DOUBLE) END AS balance,
    CASE WHEN event = 'Filtered' OR age2 IS NULL OR balance2 IS NULL THEN NULL ELSE CAST(birth2 AS TIMESTAMP) END AS birth_date FROM final"""
)
def cleanse_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: map, filter, convert, deduplicate, validate, first valid key wins."""
    rows = customer_rows(spark, sf_dir)
    return rows.select(
        F.col("_row_number").alias("n"), F.col("_status").alias("status"), F.col("CustomerId").alias("customer_id"), F.col("FullName").alias("full_name"),
        F.col("Email").alias("email"), F.col("Age").alias("age"), F.col("Balance").cast("double").alias("balance"), F.col("BirthDate").alias("birth_date"),
    )


@registered(_OUTCOMES_SQL + "SELECT status, COUNT(*) AS n FROM final GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.status_counts(customer_rows(spark, sf_dir)).withColumnRenamed("_status", "status")


@registered(
    _OUTCOMES_SQL
    + "SELECT COUNT(*) AS processed, COUNT(*) FILTER (status = 'Valid') AS valid, COUNT(*) FILTER (status = 'Invalid') AS invalid, COUNT(*) FILTER (status = 'Filtered') AS filtered, COUNT(*) FILTER (status = 'Duplicate') AS duplicate FROM final"
)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.run_counters(customer_rows(spark, sf_dir))


_SUBJECT = "'The convert to {0} transformation field ''{1}'' in row ' || CAST(n AS VARCHAR) || "
_ERRORS_SQL = (
    _OUTCOMES_SQL
    + ", errors AS ("
    + " UNION ALL ".join(
        [
            "SELECT n, 'Age' AS field, 'Transformation' AS stage, " + _SUBJECT.format("integer", "Age") + "' is not a valid number for culture ''en-US''.' AS message FROM final WHERE status = 'Invalid' AND age2 IS NULL",
            "SELECT n, 'Balance', 'Transformation', " + _SUBJECT.format("decimal", "Balance") + "' is not a valid number for culture ''en-US''.' FROM final WHERE status = 'Invalid' AND age2 IS NOT NULL AND balance2 IS NULL",
            "SELECT n, 'BirthDate', 'Transformation', " + _SUBJECT.format("date", "BirthDate") + "' is not a valid date for culture ''en-US'' and format ''yyyy-MM-dd''.' FROM final WHERE status = 'Invalid' AND age2 IS NOT NULL AND balance2 IS NOT NULL AND birth2 IS NULL",
            "SELECT n, 'FullName', 'Validation', 'Field ''FullName'' is required.' FROM final WHERE status = 'Invalid' AND event IS NULL AND name2 = ''",
            "SELECT n, 'Email', 'Validation', 'Field ''Email'' must be a valid email address.' FROM final WHERE status = 'Invalid' AND event IS NULL AND LENGTH(email2) - LENGTH(REPLACE(email2, '@', '')) <> 1",
            "SELECT n, 'Age', 'Validation', 'Field ''Age'' must be between 18 and 100.' FROM final WHERE status = 'Invalid' AND event IS NULL AND (age2 < 18 OR age2 > 100)",
            "SELECT n, 'CustomerId', 'Validation', 'Upsert key field ''CustomerId'' is required.' FROM final WHERE status = 'Invalid' AND event IS NULL AND NOT broken AND CustomerId = ''",
        ]
    )
    + ") "
)


@registered(_ERRORS_SQL + "SELECT n AS row_number, field, stage, message FROM errors")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.error_rows(customer_rows(spark, sf_dir))


@registered(_ERRORS_SQL + "SELECT stage, field, REGEXP_REPLACE(message, ' in row -?[0-9]+', '') AS message, COUNT(*) AS n FROM errors GROUP BY ALL")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.error_summary(customer_rows(spark, sf_dir))


@registered(
    _ERRORS_SQL
    + """SELECT 'run-1' AS run_id, e.n AS row_number, stage, field, message, CustomerId AS key, FullName AS source_name, CASE WHEN REGEXP_MATCHES(Balance, '^\\s*[=+@-]') THEN '''' || Balance ELSE Balance END AS source_balance
    FROM errors e JOIN final f ON e.n = f.n"""
)
def error_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = error_report(customer_rows(spark, sf_dir), "run-1", "CustomerId")
    names = {"RunId": "run_id", "SourceRowNumber": "row_number", "ErrorStage": "stage", "ErrorField": "field", "ErrorMessage": "message", "EffectiveUpsertKeyValue": "key", "Source:FullName": "source_name", "Source:Balance": "source_balance"}
    return report.select(*(F.col(f"`{a}`").alias(b) for a, b in names.items()))


@registered(_OUTCOMES_SQL + "SELECT n, status, CustomerId AS customer_id FROM final ORDER BY n LIMIT 100")
def preview_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 source rows, with a scope of their own for duplicates (the same here, since owners are earlier rows)."""
    rows = compile_rows(counters.preview(dirty_customers(spark, sf_dir), "n"), CUSTOMERS, "n")
    return rows.select(F.col("_row_number").alias("n"), F.col("_status").alias("status"), F.col("CustomerId").alias("customer_id"))


@registered(
    _OUTCOMES_SQL
    + """SELECT n, status, CASE WHEN CustomerId = '' THEN '(empty)' ELSE CustomerId END AS customer_id, CASE WHEN name2 = '' THEN '(empty)' ELSE name2 END AS full_name, CAST(age2 AS VARCHAR) AS age
    FROM final WHERE status = 'Valid' OR (status = 'Invalid' AND event IS NULL)"""
)
def preview_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = counters.preview_table(counters.transformed_rows(customer_rows(spark, sf_dir)))
    return shown.select(F.col("_row_number").alias("n"), F.col("_status").alias("status"), F.col("CustomerId").alias("customer_id"), F.col("FullName").alias("full_name"), F.col("Age").alias("age"))


# ---- single operators

@registered("SELECT c_custkey AS customer_id, c_name AS full_name, c_acctbal AS balance FROM customer")
def map_rename_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    mappings = (FieldMapping("c_custkey", "customer_id"), FieldMapping("c_name", "full_name"), FieldMapping("c_mktsegment", "segment", included=False), FieldMapping("c_acctbal", "balance"))
    return apply(table(spark, sf_dir, "customer"), mappings)


def _one(source: DataFrame, rules, validations=(), options=SourceOptions("en-US", "yyyy-MM-dd"), scale: int = 2) -> DataFrame:
    """Rows of (n, v) with rules on v and n as the key."""
    pipeline = _pipeline("one", ("n", "v"), "n", rules, validations, options, scale)
    return compile_rows(source, pipeline, "n", with_source=False).select("n", F.col("_status").alias("status"), "v")


def _values(spark: SparkSession, sf_dir: str, name: str, key: str, expression: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("n"), F.expr(expression).alias("v"))


_PADDED = "CASE WHEN c_custkey % 4 = 0 THEN '  ' || c_name || '  ' WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_name END"


@registered(f"SELECT c_custkey AS n, 'Valid' AS status, TRIM({_PADDED}) AS v FROM customer")
def trim_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(_values(spark, sf_dir, "customer", "c_custkey", _PADDED), [_rule(1, "Trim", "v")])


@registered("SELECT c_custkey AS n, 'Valid' AS status, UPPER(c_name) AS v FROM customer")
def to_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(_values(spark, sf_dir, "customer", "c_custkey", "c_name"), [_rule(1, "ToUpper", "v")])


@registered("SELECT c_custkey AS n, 'Valid' AS status, LOWER(c_mktsegment) AS v FROM customer")
def to_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(_values(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), [_rule(1, "ToLower", "v")])


@registered("SELECT o_orderkey AS n, 'Valid' AS status, STRFTIME(o_orderdate, '%m/%d/%Y %H:%M:%S') AS v FROM orders")
def to_string_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(_values(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), [_rule(1, "ConvertToString", "v")])


@registered("SELECT o_orderkey AS n, 'Valid' AS status, CAST(o_custkey AS VARCHAR) AS v FROM orders")
def to_string_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(_values(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), [_rule(1, "ConvertToString", "v")])


_NUMBERS = "CASE WHEN o_orderkey % 11 = 0 THEN 'x' || CAST(o_custkey AS VARCHAR(20)) WHEN o_orderkey % 7 = 0 THEN CAST(o_custkey AS VARCHAR(20)) || '.5' WHEN o_orderkey % 5 = 0 THEN ' -1,' || CAST(100 + o_custkey % 900 AS VARCHAR(20)) || '.00 ' WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR(20)) || '-' ELSE CAST(o_custkey AS VARCHAR(20)) END"
_NUMBER_SQL = f"SELECT o_orderkey AS n, CASE WHEN s LIKE '%-' THEN '-' || REPLACE(s, '-', '') ELSE REPLACE(TRIM(s), ',', '') END AS t FROM (SELECT o_orderkey, {_NUMBERS} AS s FROM orders)"


@registered(f"SELECT n, CASE WHEN d IS NULL OR d <> FLOOR(d) THEN 'Invalid' ELSE 'Valid' END AS status, CASE WHEN d = FLOOR(d) THEN CAST(d AS BIGINT) END AS v FROM (SELECT n, TRY_CAST(t AS DECIMAL(18,2)) AS d FROM ({_NUMBER_SQL}))")
def to_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(_values(spark, sf_dir, "orders", "o_orderkey", _NUMBERS), [_rule(1, "ConvertToInteger", "v")])


@registered(f"SELECT n, CASE WHEN d IS NULL THEN 'Invalid' ELSE 'Valid' END AS status, CAST(d AS DOUBLE) AS v FROM (SELECT n, TRY_CAST(t AS DECIMAL(18,2)) AS d FROM ({_NUMBER_SQL}))")
def to_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(_values(spark, sf_dir, "orders", "o_orderkey", _NUMBERS), [_rule(1, "ConvertToDecimal", "v")]).withColumn("v", F.col("v").cast("double"))


_DATES = "CASE WHEN o_orderkey % 13 = 0 THEN '1998-4-12' WHEN o_orderkey % 17 = 0 THEN 'soon' ELSE '19' || CAST(60 + o_orderkey % 40 AS VARCHAR(20)) || '-' || CAST(10 + o_orderkey % 3 AS VARCHAR(20)) || '-' || CAST(10 + o_orderkey % 19 AS VARCHAR(20)) END"


@registered(f"SELECT n, CASE WHEN d IS NULL THEN 'Invalid' ELSE 'Valid' END AS status, CAST(d AS TIMESTAMP) AS v FROM (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE TRY_CAST({_DATES} AS DATE) END AS d FROM orders)")
def to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(_values(spark, sf_dir, "orders", "o_orderkey", _DATES), [_rule(1, "ConvertToDate", "v")])


_MONTH = "CASE EXTRACT(MONTH FROM o_orderdate) {} END"
_DAY, _YEAR = "CAST(EXTRACT(DAY FROM o_orderdate) AS VARCHAR(2))", "CAST(EXTRACT(YEAR FROM o_orderdate) AS VARCHAR(4))"


def _dated(culture: str, show: str) -> str:
    """The order's date as text, with the month's name in a culture."""
    names = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(LOCALES[culture].months[0], 1))
    return show.format(day=_DAY, year=_YEAR, month=_MONTH.format(names))


#: Cultures, formats, and how the text is made of the date's parts.
_CULTURE_DATES = [
    ("tr-TR", "d MMMM yyyy", "{day} || ' ' || {month} || ' ' || {year}"),
    ("de-DE", None, "{day} || '. ' || {month} || ' ' || {year}"),
    ("fr-FR", None, "{day} || ' ' || UPPER({month}) || ' ' || {year}"),
    ("en-US", None, "{month} || ' ' || {day} || ', ' || {year}"),
]


@registered(" UNION ALL ".join(f"SELECT o_orderkey AS n, '{c}' AS culture, 'Valid' AS status, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS v FROM orders" for c, _, _ in _CULTURE_DATES))
def to_date_cultures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with month names, by exact formats and by the patterns of a culture."""
    parts = [
        _one(_values(spark, sf_dir, "orders", "o_orderkey", _dated(c, show)), [_rule(1, "ConvertToDate", "v")], options=SourceOptions(c, f)).select("n", F.lit(c).alias("culture"), "status", "v")
        for c, f, show in _CULTURE_DATES
    ]
    return reduce(DataFrame.unionByName, parts)


_TWO = "RIGHT('0' || {}, 2)"
_MONTH_NUMBER = "CAST(EXTRACT(MONTH FROM o_orderdate) AS VARCHAR(2))"
#: Formats, cultures, and texts: years of two and five digits, a culture's own short date, and one with a time.
_FORMAT_DATES = [
    ("MM/dd/yy", "en-US", f"{_TWO.format(_MONTH_NUMBER)} || '/' || {_TWO.format(_DAY)} || '/' || RIGHT({_YEAR}, 2)"),
    ("dd.MM.yyyyy", "de-DE", f"{_TWO.format(_DAY)} || '.' || {_TWO.format(_MONTH_NUMBER)} || '.0' || {_YEAR}"),
    ("d", "tr-TR", f"{_DAY} || '.' || {_MONTH_NUMBER} || '.' || {_YEAR}"),
    ("g", "en-GB", f"{_DAY} || '/' || {_MONTH_NUMBER} || '/' || {_YEAR} || ' 17:05'"),
]


@registered(" UNION ALL ".join(f"SELECT o_orderkey AS n, '{f}' AS format, 'Valid' AS status, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL {1025 if f == 'g' else 0} MINUTE AS v FROM orders" for f, _, _ in _FORMAT_DATES))
def to_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        _one(_values(spark, sf_dir, "orders", "o_orderkey", show), [_rule(1, "ConvertToDate", "v")], options=SourceOptions(c, f)).select("n", F.lit(f).alias("format"), "status", "v")
        for f, c, show in _FORMAT_DATES
    ]
    return reduce(DataFrame.unionByName, parts)


_HOLES = "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_name END"


@registered(f"SELECT n, 'Valid' AS status, CASE WHEN v IS NULL OR v = '' THEN 'none' ELSE v END AS v FROM (SELECT p_partkey AS n, {_HOLES} AS v FROM part)")
def default_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(_values(spark, sf_dir, "part", "p_partkey", _HOLES), [_rule(1, "SetDefaultValue", "v", Value="none")])


@registered("SELECT p_partkey AS n, 'Valid' AS status, REPLACE(p_name, 'a', '.*') AS v FROM part")
def find_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(_values(spark, sf_dir, "part", "p_partkey", "p_name"), [_rule(1, "FindAndReplace", "v", Find="a", Replace=".*")])


_OPERATOR_SQL = {"Equals": "=", "NotEquals": "<>", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}


def _filters(name: str, key: str, column: str, constant: str, sql_constant: str, before: tuple[Transformation, ...] = (), show: str = "") -> None:
    """One query over all six operators, for one type of column."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for operator in _OPERATOR_SQL:
            rows = _one(_values(spark, sf_dir, name, key, column), [*before, _rule(9, "FilterRow", "v", Operator=operator, Value=constant)]).select("n", F.lit(operator).alias("operator"), "status")
            out = rows if out is None else out.unionByName(rows)
        return out

    query.__name__ = f"filter_row_{show}"
    parts = [f"SELECT {key} AS n, '{o}' AS operator, CASE WHEN COALESCE(({column}) {s} {sql_constant}, FALSE) THEN 'Filtered' ELSE 'Valid' END AS status FROM {name}" for o, s in _OPERATOR_SQL.items()]
    registered(" UNION ALL ".join(parts))(query)


_filters("orders", "o_orderkey", "o_orderpriority", "3-MEDIUM", "'3-MEDIUM'", show="text")
_filters("orders", "o_orderkey", "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END", "500", "500", show="integer")
_filters("orders", "o_orderkey", "CAST(o_custkey AS DECIMAL(20,2))", "500.00", "500", show="decimal")
_filters("orders", "o_orderkey", "o_orderdate", "1995-06-17", "TIMESTAMP '1995-06-17'", show="date")


def _validation(show: str, rule: Validation, name: str, key: str, column: str, bad: str, before: tuple[Transformation, ...] = ()) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _one(_values(spark, sf_dir, name, key, column), before, [rule]).select("n", "status")

    query.__name__ = f"v_{show}"
    registered(f"SELECT n, CASE WHEN COALESCE({bad}, FALSE) THEN 'Invalid' ELSE 'Valid' END AS status FROM (SELECT {key} AS n, {column} AS v FROM {name})")(query)


_validation("required", Validation("Required", "v"), "part", "p_partkey", _HOLES, "v IS NULL OR TRIM(v) = ''")
_validation("email", Validation("EmailFormat", "v"), "customer", "c_custkey", "CASE WHEN c_custkey % 6 = 0 THEN '@' || c_name WHEN c_custkey % 5 = 0 THEN c_name || '@a@b' WHEN c_custkey % 4 = 0 THEN c_name || '@' WHEN c_custkey % 3 = 0 THEN NULL ELSE ' ' || c_name || '@x ' END", "v LIKE '@%' OR v LIKE '%@' OR LENGTH(v) - LENGTH(REPLACE(v, '@', '')) <> 1")
_validation("numeric_range", Validation("NumericRange", "v", {"Minimum": "100", "Maximum": "1,000"}), "orders", "o_orderkey", "o_custkey", "v < 100 OR v > 1000")
_validation("text_length", Validation("TextLengthRange", "v", {"Minimum": "10", "Maximum": "2000"}), "documents", "doc_id", "text", "TRIM(v) <> '' AND (LENGTH(v) < 10 OR LENGTH(v) > 2000)")
_validation("date_range", Validation("DateRange", "v", {"Minimum": "1994-01-01", "Maximum": "1996-12-31"}), "orders", "o_orderkey", "o_orderdate", "v < TIMESTAMP '1994-01-01' OR v > TIMESTAMP '1996-12-31'")
_validation("key_required", Validation("UpsertKeyRequired", "v"), "part", "p_partkey", _HOLES, "v IS NULL OR TRIM(v) = ''")


# ---- deduplication

EVENTS = _pipeline("events", ("event_id", "user_id", "event_type"), "event_id", [_rule(1, "Deduplicate", Fields=["user_id", "event_type"])])


@registered("SELECT event_id, user_id, event_type, CASE WHEN ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'Valid' ELSE 'Duplicate' END AS status FROM events")
def dedup_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_rows(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), EVENTS, "event_id", with_source=False).select("event_id", "user_id", "event_type", F.col("_status").alias("status"))


ORDERS = _pipeline("orders", ("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", (), [])


@registered("SELECT o_orderkey, o_custkey, CASE WHEN ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 'Valid' ELSE 'Duplicate' END AS status FROM orders")
def upsert_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ORDERS, "o_orderkey", with_source=False).select("o_orderkey", "o_custkey", F.col("_status").alias("status"))


TWO_KEYS = _pipeline(
    "two keys",
    ("event_id", "user_id", "event_type", "value"),
    "event_id",
    [_rule(1, "Deduplicate", Fields=["user_id"]), _rule(2, "Deduplicate", Fields=["value", "event_type"])],
)


# in rounds: of the rows that wait, those first in both keys win, and those that share a key with a winner go; decided rows leave the rounds
@registered(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, FLOOR(value) AS v FROM events), rounds AS (
        SELECT event_id, user_id, event_type, v, 'Waiting' AS status FROM e
        UNION ALL
        SELECT event_id, user_id, event_type, v, CASE WHEN won THEN 'Valid' WHEN BOOL_OR(won) OVER (PARTITION BY user_id) OR BOOL_OR(won) OVER (PARTITION BY event_type, v) THEN 'Duplicate' ELSE 'Waiting' END
        FROM (SELECT *, event_id = MIN(event_id) OVER (PARTITION BY user_id) AND event_id = MIN(event_id) OVER (PARTITION BY event_type, v) AS won FROM rounds WHERE status = 'Waiting'))
    SELECT event_id, status FROM rounds WHERE status <> 'Waiting'"""
)
def dedup_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys and the upsert key: rounds in SQL, too, since a row that is refused for one key does not take the other."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor("value").alias("value"))
    return compile_rows(events, TWO_KEYS, "event_id", with_source=False).select("event_id", F.col("_status").alias("status"))


# ---- schemas and sources

_KIND_SQL = """CASE WHEN COUNT(*) FILTER (TRIM(v) <> '') = 0 THEN 'Unknown'
    WHEN COUNT(*) FILTER (TRIM(v) <> '' AND NOT REGEXP_MATCHES(v, '^\\s*[0-9]+\\s*$')) = 0 THEN 'Integer'
    WHEN COUNT(*) FILTER (TRIM(v) <> '' AND NOT REGEXP_MATCHES(v, '^\\s*[0-9,]+([.][0-9]*)?\\s*$')) = 0 THEN 'Decimal'
    WHEN COUNT(*) FILTER (TRIM(v) <> '' AND NOT REGEXP_MATCHES(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) = 0 THEN 'Date' ELSE 'String' END"""
def _inferred_sql(columns: dict[str, str], names: dict[str, str] | None = None) -> str:
    """(position, field, type) of columns over the dirty customers."""
    parts = (f"SELECT {i} AS position, '{(names or {}).get(c, c)}' AS field, {_KIND_SQL} AS type FROM (SELECT {e} AS v FROM ({_DIRTY_SQL}))" for i, (c, e) in enumerate(columns.items()))
    return " UNION ALL ".join(parts)


def _inferred(spark: SparkSession, sf_dir: str, columns: dict[str, str], names: dict[str, str] | None = None) -> DataFrame:
    rows = dirty_customers(spark, sf_dir).select(*(F.expr(e).cast("string").alias((names or {}).get(c, c)) for c, e in columns.items()))
    return schema.infer(rows, SourceOptions("en-US", "yyyy-MM-dd"))


_CLEAN = repaired(*REPAIRS)


@registered(_inferred_sql(_CLEAN))
def infer_text_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inferred(spark, sf_dir, _CLEAN)


_CHANGED, _RENAMED = repaired("Balance", "BirthDate"), {"CustomerId": "Customer"}
_COMPARED_SQL = f"WITH a AS ({_inferred_sql(_CLEAN)}), b AS ({_inferred_sql(_CHANGED, _RENAMED)}) "


@registered(
    _COMPARED_SQL
    + """SELECT CASE WHEN b.field IS NULL THEN 'Missing' WHEN a.field IS NULL THEN 'New' ELSE 'TypeChanged' END AS change, COALESCE(a.field, b.field) AS field, a.type AS saved, b.type AS inspected
    FROM a FULL JOIN b ON a.field = b.field WHERE a.type IS DISTINCT FROM b.type
    UNION ALL SELECT 'UnresolvedMapping', field || ' -> ' || field, NULL, NULL FROM a WHERE field NOT IN (SELECT field FROM b)"""
)
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inferred schema of repaired rows against that of rows with a field renamed and Age left as it is."""
    return schema.compare(_inferred(spark, sf_dir, _CLEAN), _inferred(spark, sf_dir, _CHANGED, _RENAMED), CUSTOMERS.mappings)


def _pairs(inferred: DataFrame) -> schema.Schema:
    return [(r["field"], r["type"]) for r in inferred.orderBy("position").collect()]


@registered(
    f"WITH a AS ({_inferred_sql(_CLEAN)}), b AS ({_inferred_sql(repaired())})"
    + """ SELECT 'Source' AS component, 'The source schema has changed: ' || STRING_AGG('field ' || CHR(39) || a.field || CHR(39) || ' changed from ' || a.type || ' to ' || b.type, '; ' ORDER BY a.position) || '.' AS message
    FROM a JOIN b ON a.field = b.field WHERE a.type <> b.type
    UNION ALL SELECT 'Destination', 'The destination has no column ' || CHR(39) || field || CHR(39) || '.' FROM a WHERE field = 'Country'"""
)
def readiness_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift guard and readiness: a pipeline that saved the repaired rows' schema, before a run over the dirty ones into a table without Country."""
    saved, found = _pairs(_inferred(spark, sf_dir, _CLEAN)), _pairs(_inferred(spark, sf_dir, repaired()))
    pipeline = dataclasses.replace(CUSTOMERS, schema=tuple(saved))
    return spark.createDataFrame(readiness.problems(pipeline, found, [c for c in FIELDS if c != "Country"]), "component string, message string")


_COARSE_SQL = "SELECT column_name AS field, CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'Integer' WHEN column_type = 'DOUBLE' THEN 'Decimal' WHEN column_type LIKE 'TIMESTAMP%' THEN 'Date' ELSE 'String' END AS type FROM (DESCRIBE {})"


@registered(" UNION ALL ".join(_COARSE_SQL.format(name) for name in ("lineitem", "customer")))
def relational_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [pair for name in ("lineitem", "customer") for pair in schema.relational(table(spark, sf_dir, name).schema)]
    return spark.createDataFrame(pairs, "field string, type string")


@registered(
    f"WITH src AS ({_DIRTY_SQL} ORDER BY n LIMIT 100) "
    + " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS field, {_KIND_SQL} AS type, ARG_MIN(v, n) AS first_value, COUNT(*) AS n_rows FROM (SELECT n, {c} AS v FROM src)" for i, c in enumerate(FIELDS))
)
def inspect_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, first rows and schema of a source, as one look at its first 100 rows gives them."""
    seen = inspection.inspect(dirty_customers(spark, sf_dir), "n", SourceOptions("en-US", "yyyy-MM-dd"))
    first = seen.rows.orderBy("n").limit(1)
    firsts = first.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("first_value")) for c in seen.fields))).alias("f")).select("f.*")
    return seen.schema.join(firsts, F.col("field") == F.col("name")).crossJoin(F.broadcast(seen.rows.agg(F.count("*").alias("n_rows")))).select("position", "field", "type", "first_value", "n_rows")


@registered(
    """SELECT 'l_orderkey' AS columns, COUNT(*) AS n_rows, COUNT(DISTINCT l_orderkey) AS n_distinct, CAST(0 AS BIGINT) AS n_null, FALSE AS is_key FROM lineitem
    UNION ALL SELECT 'l_orderkey,l_linenumber', COUNT(*), COUNT(DISTINCT (l_orderkey, l_linenumber)), 0, COUNT(*) = COUNT(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
    UNION ALL SELECT 'l_partkey,l_suppkey', COUNT(*), COUNT(DISTINCT (l_partkey, l_suppkey)), 0, COUNT(*) = COUNT(DISTINCT (l_partkey, l_suppkey)) FROM lineitem"""
)
def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate.candidate_keys(table(spark, sf_dir, "lineitem"), [["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]])
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("n_rows", "n_distinct", "n_null")})


_KEY_COLUMNS = {"lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "orders": ("o_orderkey", "o_custkey", "o_orderpriority"), "events": ("event_id", "user_id", "event_type")}
_SETS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS name, '{','.join(s)}' AS key, {sum(1 << columns.index(c) for c in s)} AS mask, COUNT(*) = COUNT(DISTINCT ({', '.join(s)})) AS is_key FROM {name}"
    for name, columns in _KEY_COLUMNS.items()
    for size in (1, 2, 3)
    for s in itertools.combinations(columns, size)
)


@registered(f"WITH k AS ({_SETS_SQL}) SELECT name, key FROM k a WHERE is_key AND NOT EXISTS (SELECT 1 FROM k b WHERE b.name = a.name AND b.is_key AND b.mask <> a.mask AND (a.mask & b.mask) = b.mask)")
def discovered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest sets of up to three columns that identify all rows of three tables, found without being told."""
    rows = [(name, ",".join(k.columns)) for name, columns in _KEY_COLUMNS.items() for k in deduplicate.discover_keys(table(spark, sf_dir, name), 3, list(columns))]
    return spark.createDataFrame(rows, "name string, key string")


@registered("SELECT DISTINCT key AS field, 'Integer' AS type FROM (SELECT UNNEST(JSON_KEYS(props)) AS key FROM events)")
def doc_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.document_schema(documents.documents(table(spark, sf_dir, "events"), "props"), strict=True)


@registered("SELECT event_id, CAST(JSON_EXTRACT(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS note FROM events")
def doc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.shape(documents.documents(table(spark, sf_dir, "events"), "props", "event_id"), [("k", "Integer"), ("note", "String")])


@registered("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS row_number FROM orders")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_numbers(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], column="row_number").select("o_orderkey", "row_number")


@registered("SELECT LEAST(COUNT(*), 100001) AS n_rows, COUNT(*) <= 100000 AS accepted FROM lineitem")
def row_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(table(spark, sf_dir, "lineitem"), 100_000)


# ---- upserts

def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All customers, and a row for each customer of the orders under twice its number: some are known, some not."""
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    batch = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 2).alias("c_custkey")).agg(F.min("o_orderpriority").alias("c_name"), F.max("o_totalprice").alias("c_acctbal"))
    return target, batch


_MERGED_SQL = """WITH t AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer),
b AS (SELECT o_custkey * 2 AS c_custkey, MIN(o_orderpriority) AS c_name, MAX(o_totalprice) AS c_acctbal FROM orders GROUP BY 1)
SELECT COALESCE(b.c_custkey, t.c_custkey) AS c_custkey, COALESCE(b.c_name, t.c_name) AS c_name, COALESCE(b.c_acctbal, t.c_acctbal) AS c_acctbal, {segment} AS c_mktsegment{more}
FROM t FULL JOIN b ON t.c_custkey = b.c_custkey"""
_CHANGE_SQL = ", CASE WHEN b.c_custkey IS NULL THEN 'kept' WHEN t.c_custkey IS NULL THEN 'inserted' ELSE 'updated' END AS change"
_REPLACED_SQL = "CASE WHEN b.c_custkey IS NULL THEN t.c_mktsegment END"


@registered(_MERGED_SQL.format(segment=_REPLACED_SQL, more=_CHANGE_SQL))
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(*_sides(spark, sf_dir), "c_custkey", "replace").withColumnRenamed("_change", "change")


@registered(_MERGED_SQL.format(segment="t.c_mktsegment", more=_CHANGE_SQL))
def upsert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(*_sides(spark, sf_dir), "c_custkey", "update_columns").withColumnRenamed("_change", "change")


@registered(_MERGED_SQL.format(segment="t.c_mktsegment", more=_CHANGE_SQL))
def upsert_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with fields under other names, and one that is not loaded: they reach their columns by a mapping that is checked."""
    target, batch = _sides(spark, sf_dir)
    fields = batch.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("total"), F.lit("x").alias("note"))
    columns = (FieldMapping("id", "c_custkey"), FieldMapping("label", "c_name"), FieldMapping("total", "c_acctbal"), FieldMapping("note", "c_mktsegment", included=False))
    return merged(target, map_columns(fields, columns, "c_custkey", target.columns), "c_custkey", "update_columns").withColumnRenamed("_change", "change")


@registered(_MERGED_SQL.format(segment=_REPLACED_SQL, more=""))
def upsert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a keyed table in buckets: a first load, and a batch that rewrites the buckets of its keys."""
    target, batch = _sides(spark, sf_dir)
    stored = VersionedTable(spark, f"{shared_folder(spark)}/upserted-{uuid.uuid4().hex}", "c_custkey", buckets=8)
    stored.upsert(target)
    stored.upsert(batch)
    return stored.read()


# ---- runs, streams and files


@registered(
    _OUTCOMES_SQL
    + """, c AS (SELECT COUNT(*) AS processed, COUNT(*) FILTER (status = 'Valid') AS valid, COUNT(*) FILTER (status = 'Invalid') AS invalid, COUNT(*) FILTER (status = 'Filtered') AS filtered, COUNT(*) FILTER (status = 'Duplicate') AS duplicate FROM final)
    SELECT 1 AS run, 'Completed' AS status, c.*, valid AS inserted, 0 AS updated FROM c UNION ALL SELECT 2, 'Completed', c.*, 0, valid FROM c"""
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the flagship pipeline into one table, as the history tells them: the second one updates what the first one inserted."""
    folder = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    stored = VersionedTable(spark, f"{folder}/table", "CustomerId", buckets=4)
    for _ in range(2):
        execute(spark, dirty_customers(spark, sf_dir), CUSTOMERS, "n", stored, f"{folder}/runs")
    rows = counters.run_history(runs(spark, f"{folder}/runs"), CUSTOMERS.name)
    number = F.when(F.col("inserted") > 0, 1).otherwise(2)
    return rows.select(number.alias("run"), "status", "processed", "valid", "invalid", "filtered", "duplicate", "inserted", "updated")


@registered(_OUTCOMES_SQL + "SELECT status, COUNT(*) AS n FROM final GROUP BY status")
def saved_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship as it is saved: through JSON, with rules that were given other places and put back."""
    places = [t.order for t in CUSTOMERS.steps()]
    moved = reordered(CUSTOMERS.transformations, places[::-1])
    pipeline = Pipeline.from_json(dataclasses.replace(CUSTOMERS, transformations=reordered(moved, places[::-1])).to_json())
    return counters.status_counts(compile_rows(dirty_customers(spark, sf_dir), pipeline, "n", with_source=False)).withColumnRenamed("_status", "status")


@registered(
    """SELECT 1 AS run, 'Completed' AS status, NULL AS error, COUNT(*) AS processed, COUNT(*) AS inserted FROM orders
    UNION ALL SELECT 2, 'Failed', 'SchemaChanged: The source schema has changed: new field ' || CHR(39) || 'o_note' || CHR(39) || '; field ' || CHR(39) || 'o_totalprice' || CHR(39) || ' changed from Decimal to Integer.', 0, 0"""
)
def run_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all orders, and one behind it whose source has a field more and one of another type: it reads and writes nothing."""
    folder = f"{shared_folder(spark)}/refused-{uuid.uuid4().hex}"
    saved = Pipeline("saved orders", (("o_orderkey", "Integer"), ("o_totalprice", "Decimal")), (FieldMapping("o_orderkey", "o_orderkey"), FieldMapping("o_totalprice", "o_totalprice")), "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    stored = VersionedTable(spark, f"{folder}/table", "o_orderkey", buckets=4)
    for source in (rows, rows.withColumns({"o_totalprice": F.col("o_totalprice").cast("bigint"), "o_note": F.lit("x")})):
        execute(spark, source, saved, "o_orderkey", stored, f"{folder}/runs")
    return runs(spark, f"{folder}/runs").select(F.when(F.col("status") == "Completed", 1).otherwise(2).alias("run"), "status", "error", "processed", "inserted")


@registered("SELECT COUNT(*) AS processed, COUNT(DISTINCT o_custkey) AS valid, COUNT(*) - COUNT(DISTINCT o_custkey) AS duplicate, COUNT(DISTINCT o_custkey) AS inserted, 0 AS updated, COUNT(DISTINCT o_custkey) AS stored, 4 AS batches FROM orders")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in four files, each a micro-batch of one run: keys that a batch accepted are taken in those behind it."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rows.repartition(4, "o_orderkey").write.parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stored = VersionedTable(spark, f"{folder}/out", "o_custkey", buckets=4)
    run_stream(spark, source, ORDERS, "o_orderkey", stored, f"{folder}/checkpoint")
    counts = progress(spark, stored).agg(*(F.sum(c).alias(c) for c in ("processed", "valid", "duplicate", "inserted", "updated")), F.count("*").alias("batches"))
    return counts.crossJoin(F.broadcast(stored.read().agg(F.count("*").alias("stored")))).select("processed", "valid", "duplicate", "inserted", "updated", "stored", "batches")


@registered(f"SELECT CAST(n AS VARCHAR) AS n, {', '.join(FIELDS)} FROM ({_DIRTY_SQL})")
def delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty customers written as delimited text, and read with blanks, quotes and empty fields as they were."""
    path = f"{shared_folder(spark)}/delimited-{uuid.uuid4().hex}"
    rows = dirty_customers(spark, sf_dir)
    rows.select(F.col("n").cast("string"), *FIELDS).write.csv(path, header=True, sep=";", quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_delimited(spark, path, SourceOptions(delimiter=";")).select("n", *FIELDS)


@registered("SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, l_returnflag || CHR(10) || CHR(34) || l_linestatus || CHR(34) || CHR(13) || CHR(10) AS note, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_linestatus || ',' END AS mode FROM lineitem")
def delimited_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as delimited text with line breaks and quotes in fields, half of it with the fields in another order, in files that are split."""
    path = f"{shared_folder(spark)}/breaks-{uuid.uuid4().hex}"
    quoted = "'\"' || replace({}, '\"', '\"\"') || '\"'"
    note, mode = quoted.format("l_returnflag || '\n\"' || l_linestatus || '\"\r\n'"), quoted.format("l_linestatus || ','")
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber % 2 AS odd", "l_orderkey || '-' || l_linenumber AS id", f"{note} AS note", f"{mode} AS mode")
    # each line of these files ends in a line feed, so a partition's header is a row before its first one
    for odd, header, line in ((0, "note,id,mode", "concat_ws(',', note, id)"), (1, "id,mode,note", "concat_ws(',', id, mode, note)")):
        part = rows.where(f"odd = {odd}").selectExpr(f"{line} AS line").repartition(2)

        def headed(batches, header=header):
            first = True
            for batch in batches:
                yield pd.DataFrame({"line": [header, *batch["line"]] if first else batch["line"]})
                first = False

        part.mapInPandas(headed, "line string").write.mode("append").text(path)
    return read_delimited(spark, path).select("id", "note", "mode")


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, STRFTIME(o_orderdate, '%Y-%m-%d') AS o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS even FROM orders")
def workbook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as workbooks of some thousand rows each, with numbers, shared texts, dates and booleans as cells, and read again."""
    return _order_books(spark, sf_dir)


def _order_books(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    days = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date"))
    cells = F.struct(F.col("o_orderkey").cast("string"), "o_orderpriority", days.cast("string").alias("days"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    books = orders.groupBy(F.floor(F.col("o_orderkey") / 5000).alias("book")).agg(F.collect_list(cells).alias("rows"))
    names = ["o_orderkey", "o_orderpriority", "o_orderdate", "even"]

    def content(batches):
        for batch in batches:
            yield pd.DataFrame({"path": [f"{b}.xlsx" for b in batch["book"]], "content": [workbook.book_of("Orders", names, [tuple(r.values()) for r in rows], dated=(2,)) for rows in batch["rows"]]})

    files = books.mapInPandas(content, "path string, content binary")
    return workbook.workbook_rows(files, "orders", names, typed).select(*names)


@registered("SELECT o_orderkey AS n, 'DOUBLE' AS key_type, 'STRING' AS text_type, 'TIMESTAMP_NTZ' AS date_type, 'BOOLEAN' AS even_type, CAST(o_orderkey AS VARCHAR) AS shown_key, STRFTIME(o_orderdate, '%m/%d/%Y %H:%M:%S') AS shown_date, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS shown_even FROM orders")
def workbook_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same workbooks with cells that keep their types."""
    cells = _order_books(spark, sf_dir, typed=True)
    kinds = {"key_type": "o_orderkey", "text_type": "o_orderpriority", "date_type": "o_orderdate", "even_type": "even"}
    shown = {"shown_key": "o_orderkey", "shown_date": "o_orderdate", "shown_even": "even"}
    number = F.variant_get("o_orderkey", "$", "double").cast("bigint")
    return cells.select(number.alias("n"), *(F.schema_of_variant(c).alias(k) for k, c in kinds.items()), *(to_text(F.col(c), "variant").alias(k) for k, c in shown.items()))


@registered(
    """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS sheet, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority,
        1 + ROW_NUMBER() OVER (PARTITION BY o_orderkey // 5000, o_orderkey % 2 ORDER BY o_orderkey) AS row_number FROM orders"""
)
def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as workbooks of two worksheets each, written by tasks, and two of their four columns read again, a task for each file and worksheet."""
    path = f"{shared_folder(spark)}/books-{uuid.uuid4().hex}"
    names = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"]
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")))
    books = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 5000).alias("book")).agg(rows.alias("rows"))

    def write(batches):
        for batch in batches:
            system, folder = workbook.system_of(path)
            system.create_dir(folder)
            for book, rows in zip(batch["book"], batch["rows"]):
                sheets = {name: [tuple(names), *(tuple(r.values()) for r in rows if r["o_orderkey"] % 2 == i)] for i, name in enumerate(("Even", "Odd"))}
                with system.open_output_stream(f"{folder}/{book}.xlsx") as out:
                    out.write(workbook.book_of_sheets(sheets))
            yield batch[["book"]]

    books.mapInPandas(write, "book long").write.format("noop").mode("overwrite").save()
    cells = workbook.read_sheets(spark, path, ["even", "odd"], names, fields=["o_orderkey", "o_orderpriority"])
    return cells.select(F.col("_sheet").alias("sheet"), "o_orderkey", "o_orderpriority", F.col("_row_number").alias("row_number"))


# ---- values with a type of their own

MIXED = Pipeline(
    "mixed",
    (("id", "Integer"), ("price", "String"), ("quantity", "String")),
    (FieldMapping("id", "id"), FieldMapping("price", "price"), FieldMapping("quantity", "quantity")),
    "id",
    (_rule(1, "ConvertToDecimal", "price"), _rule(2, "ConvertToInteger", "quantity"), _rule(3, "SetDefaultValue", "quantity", Value="none")),
    (Validation("NumericRange", "price", {"Minimum": "0.000000001", "Maximum": "2000"}),),
    SourceOptions("en-US"),
    carrier="variant",
)
# a price of 12 fraction digits or more; some prices and quantities are no numbers, some are missing
_MIXED = {
    "price": "CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 'free' ELSE CAST(l_partkey AS VARCHAR(20)) || '.12345678901' || CAST(l_linenumber AS VARCHAR(20)) END",
    "quantity": "CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN 'many' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) END",
}
_BAD_PRICE, _BAD_QUANTITY = "price = 'free'", "COALESCE(quantity, '') = 'many'"


@registered(
    f"""SELECT id, CASE WHEN {_BAD_PRICE} OR {_BAD_QUANTITY} OR TRY_CAST(price AS DOUBLE) > 2000 THEN 'Invalid' ELSE 'Valid' END AS status, price,
    CASE WHEN {_BAD_PRICE} THEN 'STRING' ELSE 'DECIMAL' END AS price_type, CASE WHEN {_BAD_PRICE} OR {_BAD_QUANTITY} THEN quantity ELSE COALESCE(quantity, 'none') END AS quantity,
    CASE WHEN {_BAD_PRICE} THEN CASE WHEN quantity IS NOT NULL THEN 'STRING' END WHEN quantity IS NULL OR {_BAD_QUANTITY} THEN 'STRING' ELSE 'BIGINT' END AS quantity_type
    FROM (SELECT l_orderkey * 8 + l_linenumber AS id, {_MIXED["price"]} AS price, {_MIXED["quantity"]} AS quantity FROM lineitem)"""
)
def mixed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items, in fields whose values have types of their own: decimals with all their digits, defaults of another type, and what rows that failed held then."""
    source = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber AS id", *(f"{e} AS {c}" for c, e in _MIXED.items()))
    rows = compile_rows(source, MIXED, "id", with_source=False)
    kind = {c: F.regexp_replace(F.schema_of_variant(c), r"\(.*", "") for c in ("price", "quantity")}
    return rows.select(F.col("_row_number").alias("id"), F.col("_status").alias("status"), to_text(F.col("price"), "variant").alias("price"), kind["price"].alias("price_type"), to_text(F.col("quantity"), "variant").alias("quantity"), kind["quantity"].alias("quantity_type"))


# ---- the measured run

HARNESS = Pipeline(
    "harness",
    tuple((f, "String") for f in ("id", "name", "email", "quantity", "price", "shipped")),
    tuple(FieldMapping(f, f) for f in ("id", "name", "email", "quantity", "price", "shipped")),
    "id",
    (_rule(1, "Trim", "name"), _rule(2, "ConvertToInteger", "quantity"), _rule(3, "ConvertToDecimal", "price"), _rule(4, "ConvertToDate", "shipped")),
    (Validation("Required", "name"), Validation("EmailFormat", "email"), Validation("NumericRange", "quantity", {"Minimum": "1", "Maximum": "50"}), Validation("DateRange", "shipped", {"Minimum": "1990-01-01", "Maximum": "2030-12-31"})),
    SourceOptions("en-US", "yyyy-MM-dd"),
    2,
)


def harness_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS n",
        "CAST(l_orderkey * 8 + l_linenumber AS STRING) AS id",
        "'  ' || l_returnflag || l_linestatus || ' ' AS name",
        "'u' || l_suppkey || '@example.com' AS email",
        "CAST(CAST(l_quantity AS BIGINT) AS STRING) AS quantity",
        "CAST(l_partkey AS STRING) || '.25' AS price",
        "date_format(l_shipdate, 'yyyy-MM-dd') AS shipped",
    )


@registered("SELECT 'Valid' AS status, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem")
def harness_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four transformations, four validations and the upsert key over lineitem as text."""
    rows = compile_rows(harness_source(spark, sf_dir), HARNESS, "n", with_source=False)
    return rows.groupBy(F.col("_status").alias("status")).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


