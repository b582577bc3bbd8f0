"""The error report: one line for each error of each invalid row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions import variants
from rowmill.operators.mapping import quoted
from rowmill.operators.transformations import to_text


def guarded(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula, behind a quote."""
    return F.when(c.rlike(r"^[\p{Z}\p{Cc}]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def _cell(c: Column, kind: str) -> Column:
    if kind == "variant":
        return variants.by_type(c, lambda name, value: _cell(value, name), F.lit(None).cast("string"))
    if kind == "boolean":
        return c.cast("string")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0"))
    shown = to_text(c, kind)
    return guarded(c.cast("string") if shown is None else shown)


def error_report(rows: DataFrame, run_id: str, upsert_key: str) -> DataFrame:
    """The report's columns, in row order within each file when written by row number."""
    kinds = dict(rows.dtypes)
    source = rows.schema["_source"].dataType
    each = rows.where("_status = 'Invalid'").withColumn("__e", F.explode("_errors"))
    return each.select(
        F.lit(run_id).alias("RunId"),
        F.col("_row_number").alias("SourceRowNumber"),
        F.col("__e.stage").alias("ErrorStage"),
        guarded(F.col("__e.field")).alias("ErrorField"),
        F.col("__e.rule_id").alias("RuleId"),
        F.col("__e.transformation_type").alias("TransformationType"),
        guarded(F.col("__e.message")).alias("ErrorMessage"),
        _cell(quoted(upsert_key), kinds[upsert_key]).alias("EffectiveUpsertKeyValue"),
        *(_cell(F.col("_source")[f.name], f.dataType.simpleString()).alias(f"Source:{f.name}") for f in source.fields),
    )


def write_report(report: DataFrame, path: str) -> None:
    """CSV files with a header, CRLF line ends and a fixed order of rows; no file at all holds more than its range of rows."""
    report.repartitionByRange("SourceRowNumber").sortWithinPartitions("SourceRowNumber").write.csv(path, header=True, lineSep="\r\n", nullValue="", emptyValue="", quote='"', escape='"')
