"""Row numbers in source order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.plans.state import cut


def with_row_numbers(df: DataFrame, order_by: list[str], start: int = 1, column: str = "_row_number") -> DataFrame:
    """Numbers rows from `start` in the order of unique columns.

    Rows are sorted by range partitions and written; each partition then numbers its own rows behind the counts of
    those before it. Only one count for each partition goes through the driver.
    """
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ranged = cut(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, total = [], start
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before long")
    return ranged.join(F.broadcast(offsets), "__part").withColumn(column, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def gate(df: DataFrame, limit: int) -> DataFrame:
    """One row (n_rows up to limit + 1, accepted): whether a source has at most `limit` rows. Reads no more than it must."""
    return df.limit(limit + 1).agg(F.count("*").alias("n_rows")).withColumn("accepted", F.col("n_rows") <= limit)
