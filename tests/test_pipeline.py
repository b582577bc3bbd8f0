"""Whole runs: golden outcomes, and the plan against a sequential model on random rows."""

import random

import pytest
from pyspark.sql import functions as F

from rowmill import queries
from rowmill.operators import counters, schema
from rowmill.plans.compiler import compile_rows
from rowmill.plans.spec import FieldMapping, Pipeline, SourceOptions, Transformation, Validation, reordered
from rowmill.plans.run import execute
from rowmill.sinks.error_report import error_report, guarded
from rowmill.sinks.upsert import VersionedTable
from rowmill.sources.delimited import read_delimited
from rowmill.sources.order import with_row_numbers

FIELDS = queries.FIELDS
ROWS = [
    ("1", "  A B  ", "a@x.com", "28", "1500.5", "1998-04-12", "Turkey"),
    ("2", "C", "c-x.com", "35", "4200.75", "1991-08-23", "Turkey"),
    ("3", "D", "d@x.com", "abc", "2800.0", "1995-03-10", "Turkey"),
    ("4", "E", "e@x.com", "33", "NO", "1993-11-18", "Turkey"),
    ("5", "F", "f@x.com", "29", "1800.25", "never", "Turkey"),
    ("6", "", "g@x.com", "40", "3500.5", "1986-06-02", "Turkey"),
    ("7", "H", "h@x.com", "-5", "1200.0", "2001-02-11", "Turkey"),
    ("9", "I", "i@x.com", "26", "1900.0", "2000-01-01", ""),
    ("10", "J", "j@x.com", "30", "2200.0", "1996-08-15", "Turkey"),
    ("10", "K", "k@x.com", "31", "2400.0", "1995-07-10", "Turkey"),
    ("", "L", "l@x.com", "23", "1400.9", "2003-05-16", "Turkey"),
    ("12", "M", None, "27", "3400.25", "1999-12-03", None),
]


def customers(spark, rows=ROWS):
    return spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], "n long, " + ", ".join(f"{c} string" for c in FIELDS))


def test_statuses_and_partial_rows(spark):
    rows = compile_rows(customers(spark), queries.CUSTOMERS, "n").orderBy("_row_number").collect()
    assert "".join(r["_status"][0] for r in rows) == "VIIIIIIFVDIV"
    assert rows[0]["FullName"] == "A B" and rows[2]["Age"] is None and rows[2]["_source"]["Age"] == "abc"
    assert rows[6]["_errors"][0]["message"] == "Field 'Age' must be between 18 and 100."
    assert rows[10]["_errors"][0]["message"] == "Upsert key field 'CustomerId' is required."


#: The demo's dirty rows: their dirt, in order, and the status that each ends with.
DEMO = [
    ("1", "  Ann Lee  ", "  ann@example.com  ", "28", "1500.5", "1998-04-12", "Turkey", "V"),
    ("2", "Bob Ray", "bob-example.com", "35", "4200.75", "1991-08-23", "Turkey", "I"),
    ("3", "Cat Fox", "cat@example.com", "abc", "2800.0", "1995-03-10", "Turkey", "I"),
    ("4", "Dan Kay", "dan@example.com", "33", "NOT_A_NUMBER", "1993-11-18", "Turkey", "I"),
    ("5", "Eve Orr", "eve@example.com", "29", "1800.25", "invalid-date", "Turkey", "I"),
    ("6", "", "fay@example.com", "40", "3500.5", "1986-06-02", "Turkey", "I"),
    ("7", "Gil Poe", "gil@example.com", "-5", "1200.0", "2001-02-11", "Turkey", "I"),
    ("8", "Hal Roe", "hal@example.com", "200", "2700.5", "1996-05-30", "Turkey", "I"),
    ("9", "Ida Sam", "ida@example.com", "26", "1900.0", "2000-01-01", "", "F"),
    ("10", "Jon Tan", "jon@example.com", "30", "2200.0", "1996-08-15", "Turkey", "V"),
    ("10", "Jon Tan again", "jon2@example.com", "31", "2400.0", "1995-07-10", "Turkey", "D"),
    ("", "Kim Utt", "kim@example.com", "23", "1400.9", "2003-05-16", "Turkey", "I"),
    ("12", "Leo Voss", "", "27", "3400.25", "1999-12-03", "UK", "F"),
    ("13", "", "wrong-email", "wrong-age", "wrong-balance", "wrong-date", "", "F"),
    ("14", "MAY WEST", "MAY@EXAMPLE.COM", "36", "3900.5", "1990-04-22", "GERMANY", "F"),
    ("15", "Ned Young", "ned@example.com", "41", "5200.0", "1985-10-17", "Türkiye", "F"),
]


def test_demo_rows_from_a_file_into_a_table(spark, tmp_path):
    """16 rows: 2 valid, 8 invalid, 5 filtered, 1 duplicate; a second run updates what the first one inserted."""
    lines = [";".join(FIELDS), *(";".join(r[:-1]) for r in DEMO)]
    (tmp_path / "dirty.csv").write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode())
    source = with_row_numbers(read_delimited(spark, str(tmp_path / "dirty.csv"), SourceOptions(delimiter=";")), ["_position"], start=2, column="n")
    rows = compile_rows(source, queries.CUSTOMERS, "n").orderBy("_row_number").collect()
    assert "".join(r["_status"][0] for r in rows) == "".join(r[-1] for r in DEMO) and [r["CustomerId"] for r in rows if r["_status"] == "Valid"] == ["1", "10"]
    table = VersionedTable(spark, str(tmp_path / "t"), "CustomerId")
    for inserted, updated in ((2, 0), (0, 2)):
        done = execute(spark, source, queries.CUSTOMERS, "n", table, str(tmp_path / "runs"))
        assert [done.counters[c] for c in ("processed", "valid", "invalid", "filtered", "duplicate", "inserted", "updated")] == [16, 2, 8, 5, 1, inserted, updated]


def test_empty_source(spark):
    rows = compile_rows(customers(spark, []), queries.CUSTOMERS, "n")
    assert rows.count() == 0
    assert counters.run_counters(rows).first().asDict() == {"processed": 0, "valid": 0, "invalid": 0, "filtered": 0, "duplicate": 0}


def model(rows, steps):
    """Row by row, as the rules read: keys are taken only by rows that end valid."""
    taken = [set() for _ in steps]
    keys_seen, out = set(), []
    for key, a, b, bad, drop in rows:
        values = {"key": key, "a": a, "b": b}
        status, mine = None, []
        for i, step in enumerate(steps):
            if step == "drop":
                status = "Filtered" if drop == "y" else None
            elif step == "bad":
                status = "Invalid" if bad == "x" else None
            else:
                k = tuple(values[f] for f in step)
                status = "Duplicate" if k in taken[i] else None
                mine.append((i, k))
            if status:
                break
        if status is None:
            if not key:
                status = "Invalid"
            elif key in keys_seen:
                status = "Duplicate"
            else:
                status = "Valid"
                keys_seen.add(key)
                for i, k in mine:
                    taken[i].add(k)
        out.append(status)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_rows_match_the_sequential_model(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["", *"pqrstuvwxyz", *map(str, range(20))]), r.choice([None, *map(str, range(15))]), r.choice(list(map(str, range(8)))), r.choice(["1"] * 6 + ["x"]), r.choice(["n"] * 6 + ["y"])) for _ in range(120)]
    steps = [[["a"]], [["a"], ["b", "key"]], [["a", "b"], "drop", ["b"], "bad"], ["bad", ["key"]], ["drop", ["a"], "bad", ["a", "key"]], [["key"], "bad", ["a"]]][seed]
    rules = []
    for i, step in enumerate(steps):
        if step == "drop":
            rules.append(Transformation("FilterRow", i, "drop", {"Operator": "Equals", "Value": "y"}))
        elif step == "bad":
            rules.append(Transformation("ConvertToInteger", i, "bad"))
        else:
            rules.append(Transformation("Deduplicate", i, None, {"Fields": step}))
    names = ("key", "a", "b", "bad", "drop")
    pipeline = Pipeline("r", tuple((n, "String") for n in names), tuple(FieldMapping(n, n) for n in names), "key", tuple(rules))
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "n long, " + ", ".join(f"{n} string" for n in names))
    got = [x["_status"] for x in compile_rows(df, pipeline, "n").orderBy("_row_number").collect()]
    assert got == model(rows, steps)


def test_duplicates_keep_values_as_of_their_step(spark):
    pipeline = Pipeline("s", (("k", "String"), ("v", "String")), (FieldMapping("k", "k"), FieldMapping("v", "v")), "k", (Transformation("Deduplicate", 1, None, {"Fields": ["k"]}), Transformation("ToUpper", 2, "v")))
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "n long, k string, v string")
    rows = compile_rows(df, pipeline, "n").orderBy("_row_number").collect()
    assert [(r["_status"], r["v"]) for r in rows] == [("Valid", "X"), ("Duplicate", "y")]


def test_error_report_guards_formulas(spark):
    df = spark.createDataFrame([("=1",), (" +x",), ("ok",), ("a=b",), (None,)], "v string")
    assert [x[0] for x in df.select(guarded(F.col("v"))).collect()] == ["'=1", "' +x", "ok", "a=b", None]
    report = error_report(compile_rows(customers(spark), queries.CUSTOMERS, "n"), "r", "CustomerId")
    assert report.columns[:8] == ["RunId", "SourceRowNumber", "ErrorStage", "ErrorField", "RuleId", "TransformationType", "ErrorMessage", "EffectiveUpsertKeyValue"]
    assert report.count() == 7


def test_specs_round_trip_and_refuse_bad_rules():
    assert Pipeline.from_json(queries.CUSTOMERS.to_json()) == queries.CUSTOMERS
    assert [t.type for t in reordered(queries.HARNESS.transformations, [4, 1, 2, 3])] == ["ConvertToDate", "Trim", "ConvertToInteger", "ConvertToDecimal"]
    for bad in (lambda: Transformation("Nope", 1, "v"), lambda: Transformation("FilterRow", 1, "v", {"Operator": "Equals"}), lambda: Transformation("Deduplicate", 1, None, {"Fields": []}), lambda: Validation("NumericRange", "v"), lambda: SourceOptions(delimiter="|")):
        with pytest.raises(ValueError):
            bad()


def test_schema_inference(spark):
    df = spark.createDataFrame([(None, " ", "1", "1", "x", "2020-01-01", "1"), (None, None, "2,000", "1.5", "2", "2021-02-03", "2020-01-01")], "a string, b string, c string, d string, e string, f string, g string")
    got = {r["field"]: r["type"] for r in schema.infer(df, SourceOptions("en-US", "yyyy-MM-dd")).collect()}
    assert got == {"a": "Unknown", "b": "Unknown", "c": "Integer", "d": "Decimal", "e": "String", "f": "Date", "g": "String"}
    with pytest.raises(schema.SchemaChanged):
        schema.guard([("a", "String")], [("b", "String")])
