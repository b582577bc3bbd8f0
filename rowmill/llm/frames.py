"""DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The spaces that separate words, for SQL patterns.
WORD = r"[^\x20\x09-\x0D]"
#: Bytes of the tables read for each file of a table written.
FILE_BYTES = 32 << 20
#: Bytes of a row group, so that a file can be read by several tasks.
GROUP_BYTES = 8 << 20
#: Bytes of a batch that goes to Python, so that a worker's memory doesn't follow the length of texts.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where it is unset: a temporary one in local mode, as in tests; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rowmill-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def sized(df: DataFrame) -> DataFrame:
    """df in no more partitions than what it is made from calls for: one for each FILE_BYTES of the tables read, at least two for each core.

    So the number of small files follows the data, whatever the number of shuffle partitions. Nothing is shuffled; a
    task takes several of the partitions, one after the other.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.coalesce(min(1 << 30, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table of its own in the shared folder and reads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    sized(df).write.option("parquet.block.size", str(GROUP_BYTES)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table made by written() that nothing lazy reads any more."""
    spark = df.sparkSession
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch of some BATCH_BYTES."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Sets the session's bytes of a batch to BATCH_BYTES, if they are more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not str(spark.conf.get(name)).isdigit() or not 0 < int(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def text_of(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and text alone, whatever other columns there are; a null text is empty."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def hash_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most `rows` rows, the first by a hash of the columns `by`, then by those columns.

    A cut on the hash, from the count, leaves about twice as many rows to sort, so no task or driver gathers more
    as the table grows.
    """
    n = df.count()
    if n > 4 * rows:
        df = df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < int((1 << 40) * 2 * rows / n))
    return df.orderBy(F.pmod(F.xxhash64(*by), F.lit(1 << 40)), *by).limit(rows)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component the least id reachable.

    Least-neighbour propagation with pointer jumping: each round a node takes the least component of
    itself, its neighbours, and the component of its component, so the rounds grow with the logarithm
    of the diameter. Every round's state is a written table.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    state = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), name)
    while True:
        near = both.join(state, both["b"] == state["id"]).groupBy("a").agg(F.min("component").alias("m")).withColumnRenamed("a", "id")
        step = state.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        parent = state.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = written(step.join(parent, "component", "left").select("id", "old", F.least("component", F.coalesce("up", "component")).alias("component")), name)
        changed = new.where("old <> component").limit(1).count()
        dropped(state)
        state = new.select("id", "component")
        if not changed:
            dropped(both)
            return state
