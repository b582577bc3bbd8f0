"""Readiness and whole runs with their history."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from rowmill import queries
from rowmill.operators.counters import run_history, run_status
from rowmill.plans.readiness import problems
from rowmill.plans.run import Cancellation, NotReady, execute, execute_stream, runs
from rowmill.plans.spec import FieldMapping, Pipeline, Transformation, Validation
from rowmill.sinks.upsert import VersionedTable

SF = "/root/testdata/sf0.001"


def test_all_problems_are_listed(spark):
    assert problems(queries.CUSTOMERS) == []
    bad = Pipeline("p", (("a", "String"),), (FieldMapping("a", "x"),), "k", (Transformation("Trim", 1, "a"),), (Validation("NumericRange", "x", {"Minimum": "5", "Maximum": "1"}), Validation("Required", "y")))
    found = problems(bad, [("b", "String")], ["z"], ["The destination key column 'k' must not allow nulls."])
    assert [c for c, _ in found] == ["Source", "Transformations", "Validations", "Validations", "UpsertKey", "Destination", "Destination"]
    dates = Pipeline("p", (("a", "String"),), (FieldMapping("a", "a"),), "a", (), (Validation("DateRange", "a", {"Minimum": "soon"}), Validation("UpsertKeyRequired", "b")))
    assert [c for c, _ in problems(dates)] == ["Validations"] * 3


def test_runs_and_history(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "CustomerId")
    source = queries.dirty_customers(spark, SF)
    first = execute(spark, source, queries.CUSTOMERS, "n", table, str(tmp_path / "runs"), str(tmp_path / "reports"))
    again = execute(spark, source, queries.CUSTOMERS, "n", table, str(tmp_path / "runs"))
    assert first.status == again.status == "Completed"
    assert first.counters["inserted"] == first.counters["valid"] == again.counters["updated"] and again.counters["inserted"] == 0
    assert sum(first.counters[k] for k in ("valid", "invalid", "filtered", "duplicate")) == first.counters["processed"]
    assert first.report and list((tmp_path / "reports" / first.run_id).glob("*.csv"))
    rows = run_history(runs(spark, str(tmp_path / "runs")), "customers").collect()
    assert [r["run_id"] for r in rows] == [again.run_id, first.run_id] and rows[0]["duration_s"] > 0
    assert Pipeline.from_json(rows[0]["specification"]) == queries.CUSTOMERS
    failed = execute(spark, source.drop("Age"), queries.CUSTOMERS, "n", table, str(tmp_path / "runs"))
    assert failed.status == "Failed" and table.read().count() == first.counters["inserted"]
    with pytest.raises(NotReady):
        execute(spark, source, Pipeline("p", (("a", "String"),), (), "k"), "n", table, str(tmp_path / "runs"))


ORDERS = Pipeline("o", (("k", "Integer"), ("v", "Integer")), (FieldMapping("k", "k"), FieldMapping("v", "v")), "k")


def test_a_changed_source_is_refused(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k")
    good = spark.createDataFrame([(1, 1, 2)], "n long, k long, v long")
    ran = lambda source: execute(spark, source, ORDERS, "n", table, str(tmp_path / "runs"))
    for source, why in ((good.withColumn("w", F.lit(1)), "new field 'w'"), (good.drop("v"), "missing field 'v'"), (good.withColumn("v", F.lit(1.5)), "field 'v' changed from Integer to Decimal")):
        failed = ran(source)
        assert (failed.status, failed.counters["processed"]) == ("Failed", 0) and why in failed.error and table.read() is None
    assert ran(good).status == "Completed"


def test_a_run_that_is_cancelled(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k")

    @F.udf("long")
    def slow(x):
        time.sleep(0.5)
        return x

    source = spark.range(400).select(F.col("id").alias("n"), slow("id").alias("k"), F.col("id").alias("v"))
    stop = Cancellation(spark)
    timer = threading.Timer(3, stop.cancel)
    timer.start()
    began = time.time()
    ended = execute(spark, source, ORDERS, "n", table, str(tmp_path / "runs"), cancellation=stop)
    assert (ended.status, ended.counters["inserted"]) == ("Interrupted", 0) and table.read() is None and time.time() - began < 40
    assert runs(spark, str(tmp_path / "runs")).first()["status"] == "Interrupted"
    # a run that is cancelled before it begins, and one behind it that is not
    assert execute(spark, source, ORDERS, "n", table, str(tmp_path / "runs"), cancellation=stop).status == "Interrupted"
    assert execute(spark, source.limit(2).withColumn("k", F.col("n")), ORDERS, "n", table, str(tmp_path / "runs")).status == "Completed"


def test_a_stream_that_is_cancelled_keeps_its_batches(spark, tmp_path):
    for n in range(4):
        spark.createDataFrame([(n, n, n)], "n long, k long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("n long, k long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = VersionedTable(spark, str(tmp_path / "t"), "k", buckets=2)
    stop = Cancellation(spark)

    def watch():
        while not table.numbers():
            time.sleep(0.1)
        stop.cancel()

    watcher = threading.Thread(target=watch)
    watcher.start()
    ended = execute_stream(spark, source(), ORDERS, "n", table, str(tmp_path / "c"), str(tmp_path / "runs"), cancellation=stop)
    watcher.join()
    assert ended.status == "Interrupted" and 1 <= ended.counters["inserted"] == ended.counters["processed"] <= 4
    rest = execute_stream(spark, source(), ORDERS, "n", table, str(tmp_path / "c"), str(tmp_path / "runs"))
    assert rest.status == "Completed" and rest.counters["inserted"] + ended.counters["inserted"] == 4 == table.read().count()


def test_rule_configurations(spark):
    fields = tuple((f, "String") for f in ("a", "b"))
    mappings = (FieldMapping("a", "a"), FieldMapping("b", "b"))
    rules = (
        Transformation("FilterRow", 1, "b", {"Operator": "Equals", "Value": " "}, "x"), Transformation("SetDefaultValue", 2, "b", {"Value": None}), Transformation("ConvertToInteger", 3, "a"),
        Transformation("FilterRow", 4, "a", {"Operator": "Equals", "Value": "many"}), Transformation("SetDefaultValue", 5, "a", {"Value": "none"}), Transformation("FindAndReplace", 6, "b", {"Find": "a", "Replace": None}),
    )
    found = problems(Pipeline("p", fields, mappings, "b", rules, (Validation("Required", "b", id="x"), Validation("TextLengthRange", "b", {"Minimum": "x"}))))
    assert [c for c, _ in found] == ["Validations", "Transformations", "Transformations", "Transformations", "Transformations", "Transformations", "Transformations"]
    assert found[0][1] == "The text length range validation 'Minimum' configuration value 'x' is not a valid whole number." and "int()" not in str(found)
    fine = (Transformation("ConvertToInteger", 3, "a"), Transformation("SetDefaultValue", 5, "a", {"Value": "none"}))
    assert problems(Pipeline("p", fields, mappings, "b", fine, carrier="variant")) == []


def test_statuses():
    assert [run_status(None, 0), run_status("x", 0), run_status("x", 3), run_status("x", 3, True)] == ["Completed", "Failed", "PartiallyCompleted", "Interrupted"]
