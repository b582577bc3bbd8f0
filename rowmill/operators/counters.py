"""What a run reports: counters, previews, errors, and its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rowmill.functions.text import is_blank
from rowmill.operators.mapping import quoted

STATUSES = ("Valid", "Invalid", "Filtered", "Duplicate")


def counter_columns() -> list[Column]:
    return [F.count("*").alias("processed"), *(F.count_if(F.col("_status") == s).alias(s.lower()) for s in STATUSES)]


def observed(rows: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """rows with an observation that holds the counters once an action has run over them."""
    seen = Observation(name)
    return rows.observe(seen, *counter_columns()), seen


def run_counters(rows: DataFrame) -> DataFrame:
    return rows.agg(*counter_columns())


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_status").agg(F.count("*").alias("n"))


def error_rows(rows: DataFrame) -> DataFrame:
    """One row for each error: row_number, field, stage, message."""
    e = rows.where("_status = 'Invalid'").select("_row_number", F.explode("_errors").alias("e"))
    return e.select(F.col("_row_number").alias("row_number"), F.col("e.field").alias("field"), F.col("e.stage").alias("stage"), F.col("e.message").alias("message"))


def error_summary(rows: DataFrame) -> DataFrame:
    """Errors by stage, field and rule type, messages that differ only by row number together."""
    e = rows.where("_status = 'Invalid'").select(F.explode("_errors").alias("e"))
    message = F.regexp_replace("e.message", r" in row -?\d+", "")
    return e.groupBy(F.col("e.stage").alias("stage"), F.col("e.field").alias("field"), message.alias("message")).agg(F.count("*").alias("n"))


def transformed_rows(rows: DataFrame) -> DataFrame:
    """Rows whose transformations completed: valid ones, and invalid ones by validation alone."""
    by_validation = F.exists("_errors", lambda e: e["stage"] == "Validation")
    return rows.where((F.col("_status") == "Valid") | (F.col("_status") == "Invalid") & by_validation)


def shown(c: Column, kind: str) -> Column:
    """A value for display, with null, empty and blank told apart."""
    if kind != "string":
        return F.coalesce(c.cast("string"), F.lit("(null)"))
    return F.when(c.isNull(), "(null)").when(c == "", "(empty)").when(is_blank(c), "(blank)").otherwise(c)


def preview_table(rows: DataFrame) -> DataFrame:
    kinds = dict(rows.dtypes)
    fields = [c for c in rows.columns if not c.startswith("_")]
    return rows.select("_row_number", "_status", *(shown(quoted(c), kinds[c]).alias(c) for c in fields))


def preview(source: DataFrame, row_number: str, limit: int = 100) -> DataFrame:
    """The first rows of a source, for a run of their own: a top-k, not a sort of everything."""
    return source.orderBy(row_number).limit(limit)


def run_status(error: str | None, confirmed: int, cancelled: bool = False) -> str:
    if cancelled:
        return "Interrupted"
    if error is None:
        return "Completed"
    return "PartiallyCompleted" if confirmed else "Failed"


def run_history(runs: DataFrame, pipeline: str) -> DataFrame:
    """Runs of a pipeline, newest first, with their duration in seconds."""
    seconds = F.timestamp_diff("MILLISECOND", F.col("started"), F.col("finished")) / 1000
    return runs.where(F.col("pipeline") == pipeline).withColumn("duration_s", seconds).orderBy(F.desc("started"), "run_id")
