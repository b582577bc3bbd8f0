"""A pipeline over arriving files: each micro-batch is one batch of the run.

Keys accepted in earlier batches count for later ones: they are kept in the target's buckets of accepted keys, and
rows that meet them are duplicates. Each batch is one commit of the target, with its counters and its keys; a batch
that is repeated after a failure finds its own number in the log and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators.counters import counter_columns
from rowmill.plans.compiler import compile_rows
from rowmill.plans.spec import Pipeline
from rowmill.plans.state import cut, run_folder
from rowmill.sinks.typing import typed
from rowmill.sinks.upsert import VersionedTable

COUNTERS = ("processed", "valid", "invalid", "filtered", "duplicate", "inserted", "updated")


def run_stream(
    spark: SparkSession, source: DataFrame, pipeline: Pipeline, row_number: str, table: VersionedTable, checkpoint: str, on_batch: Callable[[int, DataFrame], None] | None = None,
    types: dict[str, str] | None = None, started: Callable[[object], None] | None = None,
) -> None:
    """Runs all that has arrived (availableNow), in batches as the source deals them out.

    `source` is a streaming DataFrame with a column of unique row numbers in order. Each batch's counters are in its commit. on_batch sees
    each batch's rows with their statuses, before the commit: it may run again for a batch that is repeated. `types` are the sink's types of VARIANT
    fields. `started` gets the streaming query, so that another thread can stop it.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        now = table.pointer()
        if now is not None and now["batch_id"] is not None and batch_id <= now["batch_id"]:
            return
        with run_folder(spark):
            rows = cut(compile_rows(batch, pipeline, row_number, table.taken, with_keys=True), f"batch-{batch_id}")
            counts = rows.agg(*counter_columns()).first().asDict()
            if on_batch:
                on_batch(batch_id, rows)
            valid = rows.where("_status = 'Valid'")
            keys = valid.select(F.posexplode("_keys").alias("rule", "key"))
            table.upsert(typed(valid.drop("_row_number", "_status", "_errors", "_source", "_keys"), types or {}), batch_id=batch_id, counters=counts, keys=keys)

    query = source.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if started:
        started(query)
    query.awaitTermination()


def progress(spark: SparkSession, table: VersionedTable) -> DataFrame:
    """batch_id and counters of each batch that is committed, from the table's log."""
    counts = ", ".join(f"{c}: bigint" for c in COUNTERS)
    log = spark.read.schema(f"batch bigint, counters struct<{counts}>").json(f"{table.path}/_log")
    return log.where("batch IS NOT NULL").select(F.col("batch").alias("batch_id"), "counters.*")
