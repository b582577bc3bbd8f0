"""Values with a type of their own, against Python's exact numbers."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowmill.functions import variants
from rowmill.operators.transformations import to_text
from rowmill.plans.compiler import compile_rows
from rowmill.plans.spec import FieldMapping, Pipeline, SourceOptions, Transformation, Validation
from rowmill.sinks.error_report import error_report
from rowmill.sinks.typing import typed
from rowmill.sources import workbook


def pipeline(rules=(), validations=(), fields=("id", "v"), carrier="variant", culture="en-US"):
    return Pipeline("p", tuple((f, "String") for f in fields), tuple(FieldMapping(f, f) for f in fields), "id", tuple(rules), tuple(validations), SourceOptions(culture, "yyyy-MM-dd"), carrier=carrier)


def run(spark, values, rules=(), validations=(), kind="string", **more):
    source = spark.createDataFrame([(i, str(i), v) for i, v in enumerate(values)], f"n long, id string, v {kind}")
    rows = compile_rows(source, pipeline(rules, validations, **more), "n").orderBy("_row_number")
    shown = rows.select("_status", F.schema_of_variant("v").alias("t"), to_text(F.col("v"), "variant").alias("v"), F.try_element_at("_errors", F.lit(1))["message"].alias("m"))
    return [tuple(r) for r in shown.collect()]


NUMBERS = ["0.123456789012", "1.0000000000000000000000000001", "79228162514264337593543950335", "-7922816251426433759354395033.5", "12", "-0.5", "1,234.50", "0.00000000000000000000000000001", "79228162514264337593543950336", "x", None, ""]


def test_decimals_keep_their_digits(spark):
    found = run(spark, NUMBERS, [Transformation("ConvertToDecimal", 1, "v")])
    assert [(s[0], v) for s, _, v, _ in found] == [("V", "0.123456789012"), ("V", "1.0000000000000000000000000001"), ("V", "79228162514264337593543950335"), ("V", "-7922816251426433759354395033.5"), ("V", "12"), ("V", "-0.5"), ("V", "1234.5"), ("I", NUMBERS[7]), ("I", NUMBERS[8]), ("I", "x"), ("V", None), ("I", "")]
    assert all(t.startswith("DECIMAL") for s, t, v, _ in found if s == "Valid" and v)
    assert found[7][3].endswith(" is outside the Decimal range.") and found[9][3].endswith(" is not a valid number for culture 'en-US'.")


@pytest.mark.parametrize("operator", ["Equals", "NotEquals", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual"])
def test_filters_and_ranges_are_exact(spark, operator):
    import operator as o

    compare = {"Equals": o.eq, "NotEquals": o.ne, "GreaterThan": o.gt, "GreaterThanOrEqual": o.ge, "LessThan": o.lt, "LessThanOrEqual": o.le}[operator]
    values = ["-12.345", "-12.5", "-0.5", "0", "0.3", "0.30000000000000000000000001", "12", "7922816251426433759354395033.5", "7922816251426433759354395033.4"]
    for bound in ("0.3", "-12.4", "7922816251426433759354395033.5"):
        rules = [Transformation("ConvertToDecimal", 1, "v"), Transformation("FilterRow", 2, "v", {"Operator": operator, "Value": bound})]
        assert [s == "Filtered" for s, *_ in run(spark, values, rules)] == [compare(Decimal(v), Decimal(bound)) for v in values]
    found = run(spark, values, [Transformation("ConvertToDecimal", 1, "v")], [Validation("NumericRange", "v", {"Minimum": "-12.4", "Maximum": "0.3"})])
    assert [s == "Valid" for s, *_ in found] == [Decimal("-12.4") <= Decimal(v) <= Decimal("0.3") for v in values]


def test_values_keep_their_types(spark):
    # rows that fail keep their text; a default is text among numbers; a rule sees each value's own type
    rules = [Transformation("ConvertToInteger", 1, "v"), Transformation("SetDefaultValue", 2, "v", {"Value": "none"}), Transformation("ToUpper", 3, "v")]
    assert [(s, t, v) for s, t, v, _ in run(spark, ["5", "x", None, "6.0", "7.5"], rules)] == [("Valid", "BIGINT", "5"), ("Invalid", "STRING", "x"), ("Valid", "STRING", "NONE"), ("Valid", "BIGINT", "6"), ("Invalid", "STRING", "7.5")]
    ranged = [Validation("NumericRange", "v", {"Minimum": "1", "Maximum": "9"}), Validation("Required", "v")]
    assert [s for s, *_ in run(spark, ["5", "50", None], rules[:2], ranged)] == ["Valid", "Invalid", "Invalid"]
    assert [(s, t, v) for s, t, v, _ in run(spark, ["2020-01-02", "no"], [Transformation("ConvertToDate", 1, "v"), Transformation("FilterRow", 2, "v", {"Operator": "LessThan", "Value": "2021-01-01"})])] == [("Filtered", "TIMESTAMP_NTZ", "01/02/2020 00:00:00"), ("Invalid", "STRING", "no")]
    assert [(t, v) for _, t, v, _ in run(spark, [1.5, 1e20, 3.0, None], [Transformation("ConvertToDecimal", 1, "v")], kind="double")] == [("DECIMAL(2,1)", "1.5"), ("DECIMAL(21,0)", "100000000000000000000"), ("DECIMAL(1,0)", "3"), (None, None)]
    assert [s for s, *_ in run(spark, [True, None], [Transformation("ConvertToDecimal", 1, "v")], kind="boolean")] == ["Invalid", "Valid"]


def test_keys_of_mixed_types(spark):
    source = spark.sql("SELECT id AS n, v FROM VALUES (1, CAST(1 AS VARIANT)), (2, PARSE_JSON('1.0')), (3, CAST('1' AS VARIANT)), (4, CAST(1D AS VARIANT)), (5, PARSE_JSON('null')), (6, CAST(' ' AS VARIANT)) AS t(id, v)")
    one = Pipeline("p", (("v", "String"),), (FieldMapping("v", "v"),), "v", carrier="variant")
    assert [r["_status"] for r in compile_rows(source, one, "n").orderBy("_row_number").collect()] == ["Valid", "Duplicate", "Valid", "Duplicate", "Invalid", "Invalid"]
    kept = Pipeline("p", (("v", "String"), ("n", "Integer")), (FieldMapping("v", "v"), FieldMapping("n", "n")), "n", (Transformation("Deduplicate", 1, config={"Fields": ["v"]}),), carrier="variant")
    # a Deduplicate rule tells types apart
    assert [r["_status"] for r in compile_rows(source, kept, "n").orderBy("_row_number").collect()] == ["Valid"] * 6


def test_workbook_cells_keep_their_types(spark):
    content = workbook.book_of("Data", ["id", "v"], [("1", "2.5"), ("2", "x"), ("3", True), ("4", None)])
    dated = workbook.book_of("Data", ["id", "v"], [("5", "43831.5")], dated=(1,))
    files = spark.createDataFrame([("a.xlsx", bytearray(content)), ("b.xlsx", bytearray(dated))], "path string, content binary")
    cells = workbook.workbook_rows(files, "data", ["id", "v"], typed=True).orderBy("_file", "_row_number")
    assert [(r["t"], r["v"]) for r in cells.select(F.schema_of_variant("v").alias("t"), to_text(F.col("v"), "variant").alias("v")).collect()] == [("DOUBLE", "2.5"), ("STRING", "x"), ("BOOLEAN", "True"), (None, None), ("TIMESTAMP_NTZ", "01/01/2020 12:00:00")]
    source = cells.withColumn("n", F.variant_get("id", "$", "double").cast("long"))
    rows = compile_rows(source, pipeline([Transformation("ConvertToInteger", 1, "id"), Transformation("ConvertToDate", 2, "v")]), "n").orderBy("_row_number").collect()
    assert [r["_status"] for r in rows] == ["Invalid", "Invalid", "Invalid", "Valid", "Valid"]
    report = error_report(compile_rows(source, pipeline([Transformation("ConvertToDate", 2, "v")]), "n"), "r", "id").orderBy("SourceRowNumber").collect()
    assert [(r["Source:id"], r["Source:v"]) for r in report] == [("1", "2.5"), ("2", "x"), ("3", "true")]


def test_typed_sinks(spark):
    rows = compile_rows(spark.createDataFrame([(1, "1", "0.25"), (2, "2", "3")], "n long, id string, v string"), pipeline([Transformation("ConvertToDecimal", 1, "v")]), "n")
    fields = rows.select("id", "v")
    assert {tuple(r) for r in typed(fields, {"v": "decimal(10,2)"}).collect()} == {("1", Decimal("0.25")), ("2", Decimal("3.00"))}
    assert typed(fields, {}).dtypes == [("id", "string"), ("v", "string")]
    with pytest.raises(Exception, match="is no decimal"):
        typed(fields, {"v": "decimal(10,1)"}).collect()


def test_defaults_of_typed_fields(spark):
    rules = [Transformation("ConvertToInteger", 1, "v"), Transformation("SetDefaultValue", 2, "v", {"Value": "x"})]
    source = spark.createDataFrame([(1, "1", None)], "n long, id string, v string")
    with pytest.raises(ValueError, match="no value of the type 'bigint'"):
        compile_rows(source, pipeline(rules, carrier="typed"), "n")
    good = [rules[0], Transformation("SetDefaultValue", 2, "v", {"Value": "-3"})]
    assert compile_rows(source, pipeline(good, carrier="typed"), "n").first()["v"] == -3
    assert Pipeline.from_json(pipeline(rules).to_json()) == pipeline(rules)
    assert variants.TYPES["exact"] == "DECIMAL"
