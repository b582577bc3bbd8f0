"""One whole run: check, compile, upsert, report, and a row in the run history."""

from __future__ import annotations

import contextlib
import datetime
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators import schema
from rowmill.operators.counters import counter_columns, run_status
from rowmill.plans.compiler import compile_rows
from rowmill.plans.readiness import problems
from rowmill.plans.spec import Pipeline
from rowmill.plans.state import run_folder
from rowmill.sinks.error_report import error_report, write_report
from rowmill.sinks.typing import typed
from rowmill.sinks.upsert import VersionedTable
from rowmill.streaming.batches import COUNTERS, run_stream

RUNS = "run_id string, pipeline string, specification string, status string, started timestamp, finished timestamp, processed long, valid long, invalid long, filtered long, duplicate long, inserted long, updated long, error string, report string"


#: Columns that readers of files add to the fields.
PLACES = ("_file", "_position", "_row_number")


class NotReady(ValueError):
    """The pipeline has problems; see the message."""


@dataclass(frozen=True)
class Outcome:
    run_id: str
    status: str
    counters: dict[str, int]
    error: str | None
    report: str | None


class Cancelled(RuntimeError):
    """The run was cancelled."""


class Cancellation:
    """Lets another thread end a run: its Spark jobs carry a tag of their own, its stream is stopped, and no further step begins."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.asked, self._lock = spark, f"run-{uuid.uuid4()}", False, threading.Lock()
        self._stops: list[Callable[[], None]] = []

    def cancel(self) -> None:
        with self._lock:
            self.asked = True
            stops = list(self._stops)
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        for stop in stops:
            stop()

    def check(self) -> None:
        if self.asked:
            raise Cancelled("ETL execution was interrupted.")

    def stops(self, stop: Callable[[], None]) -> None:
        """Something to call when the run is cancelled; at once, if it is."""
        with self._lock:
            self._stops.append(stop)
            late = self.asked
        if late:
            stop()

    @contextlib.contextmanager
    def tagged(self) -> Iterator[None]:
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            yield
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)


def live_schema(source: DataFrame, pipeline: Pipeline, row_number: str) -> schema.Schema:
    """The fields of a source as they are now. Raw text and VARIANT values have the saved type: their kind shows row by row."""
    saved = dict(pipeline.schema)
    out: schema.Schema = []
    for f in source.schema.fields:
        if f.name in (row_number, *PLACES) and f.name not in saved:
            continue
        if f.dataType.simpleString() in ("string", "variant"):
            out.append((f.name, saved.get(f.name, "String")))
        else:
            out += schema.relational(type(source.schema)([f]))
    return out


def _saved(pipeline: Pipeline, row_number: str, source: DataFrame) -> schema.Schema:
    """The saved schema; "String" is what a field has whose type nobody looked at, so it goes with any type only in a pipeline that has no other."""
    if all(kind == "String" for _, kind in pipeline.schema):
        return [(name, dict(live_schema(source, pipeline, row_number)).get(name, kind)) for name, kind in pipeline.schema]
    return list(pipeline.schema)


def _recorded(spark: SparkSession, pipeline: Pipeline, history: str, cancellation: Cancellation, work: Callable[[str, dict], str | None]) -> Outcome:
    """Runs work(run_id, counts), which fills in the counters and returns the report's path, and writes the run's row."""
    wrong = problems(pipeline)
    if wrong:
        raise NotReady("; ".join(f"{c}: {m}" for c, m in wrong))
    run_id, started = str(uuid.uuid4()), datetime.datetime.now()
    counts = dict.fromkeys(COUNTERS, 0)
    error = report = None
    try:
        with cancellation.tagged():
            report = work(run_id, counts)
    except Exception as problem:  # recorded, then told to the caller in the outcome
        error = "ETL execution was interrupted." if cancellation.asked else f"{type(problem).__name__}: {problem}"[:2000]
    status = run_status(error, counts["inserted"] + counts["updated"], cancelled=error is not None and cancellation.asked)
    row = (run_id, pipeline.name, pipeline.to_json(), status, started, datetime.datetime.now(), *counts.values(), error, report)
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(history)
    return Outcome(run_id, status, counts, error, report)


def execute(
    spark: SparkSession, source: DataFrame, pipeline: Pipeline, row_number: str, table: VersionedTable, history: str, reports: str | None = None,
    types: dict[str, str] | None = None, cancellation: Cancellation | None = None,
) -> Outcome:
    """Runs a pipeline over a source into a table.

    The specification is frozen into the run's row. A pipeline that is not ready raises before anything is read. A source whose fields are not those
    of the saved schema (missing, new, or of another type) ends the run as Failed before a row is read. An error while
    running ends it as Failed, a cancellation as Interrupted: the upsert is one commit, so nothing has been written by then, and the counters are
    of what is committed. `types` are the sink's types of VARIANT fields.
    """
    cancellation = cancellation or Cancellation(spark)

    def work(run_id: str, counts: dict) -> str | None:
        schema.guard(_saved(pipeline, row_number, source), live_schema(source, pipeline, row_number), pipeline.mappings)
        report = None
        with run_folder(spark):
            cancellation.check()
            rows = compile_rows(source, pipeline, row_number)  # the judged rows are written; what follows reads them
            found = rows.agg(*counter_columns()).first().asDict()
            cancellation.check()
            if reports is not None and found["invalid"]:
                report = f"{reports.rstrip('/')}/{run_id}"
                write_report(error_report(rows, run_id, pipeline.upsert_key), report)
                cancellation.check()
            done = table.upsert(typed(rows.where("_status = 'Valid'").drop("_row_number", "_status", "_errors", "_source"), types or {}), counters=found)
            counts |= found | {"inserted": done.inserted, "updated": done.updated}
        return report

    return _recorded(spark, pipeline, history, cancellation, work)


def execute_stream(
    spark: SparkSession, source: DataFrame, pipeline: Pipeline, row_number: str, table: VersionedTable, checkpoint: str, history: str,
    types: dict[str, str] | None = None, cancellation: Cancellation | None = None,
) -> Outcome:
    """The same in micro-batches: the counters are those of the batches that are committed, also if the run fails (PartiallyCompleted) or is cancelled (Interrupted)."""
    cancellation = cancellation or Cancellation(spark)

    def work(run_id: str, counts: dict) -> str | None:
        schema.guard(_saved(pipeline, row_number, source), live_schema(source, pipeline, row_number), pipeline.mappings)
        behind = (table.numbers() or [0])[-1]
        try:
            cancellation.check()
            run_stream(spark, source, pipeline, row_number, table, checkpoint, types=types, started=lambda query: cancellation.stops(query.stop))
            cancellation.check()
        finally:
            for number in table.numbers():
                if number > behind and (entry := table.commit(number)).get("batch") is not None:
                    for name in COUNTERS:
                        counts[name] += entry["counters"].get(name, 0)
        return None

    return _recorded(spark, pipeline, history, cancellation, work)


def runs(spark: SparkSession, history: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(history).orderBy(F.desc("started"))
