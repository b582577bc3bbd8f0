"""Tables that cut lineage between rounds, in the folder of spark.checkpoint.dir."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_run: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors see. Where it is unset: a temporary folder in local mode, as in tests; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rowmill-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables that are cut inside, removed at the end: nothing lazy may read them behind it."""
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        removed(spark, path)


@contextlib.contextmanager
def _whole_variants(spark: SparkSession, df: DataFrame) -> Iterator[None]:
    """Lets VARIANT values be written as they are: taken apart by type, a decimal that is whole would be read as an integer."""
    names = ("spark.sql.variant.writeShredding.enabled", "spark.sql.variant.inferShreddingSchema") if "variant" in df.schema.simpleString() else ()
    kept = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, "false")
    try:
        yield
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to a table of its own and read again."""
    spark = df.sparkSession
    path = f"{_run.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _whole_variants(spark, df):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table made by cut() that nothing lazy reads any more."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        removed(df.sparkSession, path)
