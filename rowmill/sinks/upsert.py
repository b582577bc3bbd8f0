"""Upserts of a batch with unique keys into a keyed table."""

from __future__ import annotations

import json
import os
import urllib.parse
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.operators.mapping import quoted
from rowmill.plans.spec import FieldMapping


def map_columns(rows: DataFrame, columns: tuple[FieldMapping, ...], key: str, target_columns: list[str]) -> DataFrame:
    """Output fields under their destination names. Each destination column is used once and must exist; the key must be mapped."""
    used = [m for m in columns if m.included]
    targets = [m.target for m in used]
    if len(set(targets)) < len(targets):
        raise ValueError("A destination column is mapped more than once.")
    missing = [t for t in targets if t not in target_columns]
    if missing:
        raise ValueError(f"The destination has no columns {missing}.")
    if key not in targets:
        raise ValueError(f"The destination key column '{key}' is not mapped.")
    return rows.select(*(quoted(m.source).alias(m.target) for m in used))


def merged(target: DataFrame, batch: DataFrame, key: str, mode: str = "replace") -> DataFrame:
    """The target after the upsert, with _change: inserted, updated or kept.

    replace: a batch row replaces the whole stored row, columns that it lacks become null. update_columns: only its own columns
    change. Batch columns that the target lacks are added. Keys are unique on both sides, so the join is one to one.
    """
    if mode not in ("replace", "update_columns"):
        raise ValueError(f"The upsert mode '{mode}' is not supported.")
    names = [*target.columns, *(c for c in batch.columns if c not in target.columns)]
    old = target.select(*(quoted(c).alias(f"__t{i}") for i, c in enumerate(target.columns)), F.lit(True).alias("__old"))
    new = batch.select(*(quoted(c).alias(f"__b{i}") for i, c in enumerate(batch.columns)), F.lit(True).alias("__new"))
    t, b = ({c: f"__{p}{i}" for i, c in enumerate(df.columns)} for p, df in (("t", target), ("b", batch)))
    both = old.join(new, F.col(t[key]) == F.col(b[key]), "full")
    kinds = dict(batch.dtypes) | dict(target.dtypes)
    columns = []
    for c in names:
        stored = F.col(t[c]) if c in t else F.lit(None).cast(kinds[c])
        given = F.col(b[c]).cast(kinds[c]) if c in b else (stored if mode == "update_columns" else F.lit(None).cast(kinds[c]))
        columns.append(F.when(F.col("__new"), given).otherwise(stored).alias(c))
    change = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "inserted").otherwise("updated")
    return both.select(*columns, change.alias("_change"))


@dataclass(frozen=True)
class UpsertResult:
    inserted: int
    updated: int
    version: str | None


class Conflict(RuntimeError):
    """Another writer has changed what this one's result depends on."""


class VersionedTable:
    """A keyed table in a folder, in buckets by a hash of the key, with a log of commits.

    An upsert looks in the buckets that its keys fall into for the files that hold any of them: by the ranges of keys that the log keeps for each file,
    then by the key column of those that are left. It writes the rows of these files and its own to a folder of its own; other files stay. Small files of a bucket are put
    together when they are many. Then it adds the next numbered file to the log; the
    file is made only if there is none of that number, so one of two writers wins. The other one commits behind it if
    they touched different buckets, and else merges anew. Each commit names the files of every bucket, its batch, that batch's
    counters, and the keys it accepted: all of it counts, or nothing. What a writer leaves that dies before its
    commit is not read by anyone. A table keeps the number of buckets that its first upsert gave it: about one for each gigabyte to come.
    """

    #: Files of a bucket of fewer rows than this from whose number they are put together.
    SMALL_ROWS, SMALL_FILES = 1_000_000, 8
    #: Folders of accepted keys in a bucket from which they are put together.
    KEY_FOLDERS = 8

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _file(self, name: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    # ---- the log

    def numbers(self) -> list[int]:
        """The numbers of all commits, in order."""
        system, log = self._file("_log")
        if not system.exists(log):
            return []
        names = (f.getPath().getName() for f in system.listStatus(log))
        return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit())

    def commit(self, number: int) -> dict:
        system, file = self._file(f"_log/{number:020d}.json")
        stream = system.open(file)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def pointer(self) -> dict | None:
        """The last commit."""
        numbers = self.numbers()
        return self.commit(numbers[-1]) if numbers else None

    def _committed(self, entry: dict) -> bool:
        """Adds a commit to the log unless there is one of its number."""
        system, new = self._file(f"_log/.{uuid.uuid4().hex}")
        out = system.create(new, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        _, file = self._file(f"_log/{entry['number']:020d}.json")
        uri = system.makeQualified(file).toUri()
        try:
            if uri.getScheme() == "file":
                os.link(system.makeQualified(new).toUri().getPath(), uri.getPath())  # fails if the name is taken
                system.delete(new, False)
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark._jsc.hadoopConfiguration())
                context.rename(new, file, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except (FileExistsError, Py4JJavaError):
            if not system.exists(file):
                raise
            system.delete(new, False)
            return False

    # ---- rows

    def read(self) -> DataFrame | None:
        now = self.pointer()
        return None if now is None else self._read(now, [f for files in now["folders"].values() for f in files])

    def _read(self, now: dict, files: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(now["schema"])
        paths = [f"{self.path}/{f['file']}" for f in files]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ---- files

    def _place(self, kind: T.DataType):
        """The key as the log's ranges compare it; null for types that have no ranges."""
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return quoted(self.key).cast("bigint")
        if isinstance(kind, T.DateType):
            return F.unix_date(quoted(self.key)).cast("bigint")
        return quoted(self.key) if kind == T.StringType() else F.lit(None).cast("string")

    def _ranges(self, rows: DataFrame, by: Column) -> dict[str, dict]:
        """Number of rows and range of keys of each bucket or file: a row for each. Ranges with very long keys are left open."""
        place = self._place(rows.schema[self.key].dataType)
        open_ended = F.coalesce(F.max(F.length(place.cast("string"))) > 256, F.lit(True)) | (F.count(place) < F.count("*"))
        bounds = (F.when(~open_ended, f(place)).alias(n) for f, n in ((F.min, "low"), (F.max, "high")))
        found = rows.groupBy(by.alias("at")).agg(F.count("*").alias("rows"), *bounds).collect()
        return {str(r["at"]): {"rows": r["rows"], "low": r["low"], "high": r["high"]} for r in found}

    def _holding(self, now: dict, batch: DataFrame, given: dict[str, dict]) -> list[dict]:
        """The files of a batch's buckets that hold any of its keys: at most the files of these buckets come to the driver, by name."""
        same = T.StructType.fromJson(now["schema"])[self.key].dataType == batch.schema[self.key].dataType
        apart = lambda a, b: same and None not in (a["low"], b["low"]) and (a["low"] > b["high"] or b["low"] > a["high"])
        near = [f for b, own in given.items() for f in now["folders"].get(b, ()) if not apart(f, own)]
        if not near:
            return []
        kind = T.StructType([f for f in T.StructType.fromJson(now["schema"]) if f.name == self.key])
        keys = self.spark.read.schema(kind).parquet(*(f"{self.path}/{f['file']}" for f in near)).select(quoted(self.key).alias("__key"), F.col("_metadata.file_path").alias("__file"))
        held = keys.join(batch.select(quoted(self.key).alias("__own")), F.col("__key") == F.col("__own"), "left_semi").select("__file").distinct().collect()
        names = {_inside(r[0]) for r in held}
        return [f for f in near if f["file"] in names]

    def _rewritten(self, now: dict, batch: DataFrame, given: dict[str, dict]) -> list[dict]:
        """The files that an upsert writes anew: those that hold its keys, and small ones of buckets where they are many."""
        held = self._holding(now, batch, given)
        for b in given:
            small = [f for f in now["folders"].get(b, ()) if f["rows"] < self.SMALL_ROWS]
            if len(small) >= self.SMALL_FILES:
                held += [f for f in small if f not in held]
        return held

    def upsert(self, batch: DataFrame, mode: str = "replace", batch_id: int | None = None, counters: dict | None = None, keys: DataFrame | None = None) -> UpsertResult:
        """Upserts a batch in one commit, with its counters and the keys (rule, key) that it accepted. A batch that is committed already changes nothing."""
        while True:
            now = self.pointer()
            if self._done(now, batch_id):
                return UpsertResult(0, 0, now["version"])
            found = self._tried(now, batch, mode, batch_id, counters, keys)
            if found is not None:
                return found

    @staticmethod
    def _done(now: dict | None, batch_id: int | None) -> bool:
        return now is not None and batch_id is not None and now["batch_id"] is not None and batch_id <= now["batch_id"]

    def _tried(self, now: dict | None, batch: DataFrame, mode: str, batch_id: int | None, counters: dict | None, keys: DataFrame | None) -> UpsertResult | None:
        """One try from what the table is now; None if another writer changed the same buckets meanwhile."""
        base = now or {"number": 0, "version": None, "batch_id": None, "buckets": self.buckets, "folders": {}, "schema": batch.schema.jsonValue(), "keys": {}}
        bucket = F.pmod(F.xxhash64(quoted(self.key).cast("string")), F.lit(base["buckets"]))
        given = self._ranges(batch, bucket)  # of a fixed number of buckets
        touched = list(given)
        old = self._rewritten(base, batch, given)
        version = f"v-{uuid.uuid4().hex}"
        result = merged(self._read(base, old), batch, self.key, mode)
        counts = Observation(version)
        seen = result.observe(counts, F.count_if(F.col("_change") == "inserted").alias("inserted"), F.count_if(F.col("_change") == "updated").alias("updated")).drop("_change")
        seen.withColumn("__bucket", bucket).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{version}")
        found = counts.get
        entry = base | {"version": version, "batch": batch_id, "batch_id": batch_id if batch_id is not None else base["batch_id"], "schema": seen.schema.jsonValue(), "counters": (counters or {}) | {"inserted": found["inserted"], "updated": found["updated"], "rewritten": len(old)}}
        gone = {f["file"] for f in old}
        own = {b: [f for f in base["folders"].get(b, ()) if f["file"] not in gone] for b in touched}
        if touched:
            written = self.spark.read.schema(T.StructType([seen.schema[self.key]])).parquet(f"{self.path}/{version}")
            for path, about in self._ranges(written, F.col("_metadata.file_path")).items():
                file = _inside(path)
                own[file.split("/")[1].partition("=")[2]].append({"file": file} | about)
        held = self._with_keys(base, keys) if keys is not None else base["keys"]
        while True:
            if self._committed(entry | {"number": base["number"] + 1, "folders": base["folders"] | own, "keys": held}):
                return UpsertResult(found["inserted"], found["updated"], version)
            theirs = self.pointer()
            mine = now or {"folders": {}, "schema": theirs["schema"], "keys": {}, "buckets": self.buckets}
            if keys is not None and theirs["keys"] != mine["keys"] and not self._done(theirs, batch_id):
                raise Conflict("Another stream has accepted keys in this table meanwhile: this batch's duplicates must be found anew.")
            same = theirs["schema"] == mine["schema"] == entry["schema"] and theirs["buckets"] == mine["buckets"]
            if self._done(theirs, batch_id) or not same or any(theirs["folders"].get(b) != mine["folders"].get(b) for b in touched):
                system, lost = self._file(version)
                system.delete(lost, True)
                return None
            base = theirs
            held = held if keys is not None else theirs["keys"]
            entry["batch_id"] = batch_id if batch_id is not None else theirs["batch_id"]

    # ---- accepted keys

    def _key_bucket(self, buckets: int):
        return F.pmod(F.xxhash64("rule", "key"), F.lit(buckets))

    def _with_keys(self, base: dict, keys: DataFrame) -> dict[str, list[str]]:
        """Writes accepted keys to their buckets, and returns the folders of all buckets. Buckets with many folders are written as one."""
        rows = keys.select(F.col("rule").cast("int").alias("rule"), "key")
        touched = [str(r[0]) for r in rows.select(self._key_bucket(base["buckets"]).alias("b")).distinct().collect()]
        full = [b for b in touched if len(base["keys"].get(b, ())) >= self.KEY_FOLDERS]
        if full:
            rows = rows.unionByName(self._key_rows(base, full))
        name = f"k-{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self._key_bucket(base["buckets"])).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        return base["keys"] | {b: [*(() if b in full else base["keys"].get(b, ())), f"{name}/__bucket={b}"] for b in touched}

    def _key_rows(self, now: dict, buckets: list[str]) -> DataFrame:
        folders = [f"{self.path}/{f}" for b in buckets for f in now["keys"].get(b, ())]
        return self.spark.read.schema("rule int, key string").parquet(*folders) if folders else self.spark.createDataFrame([], "rule int, key string")

    def taken(self, keys: DataFrame) -> DataFrame | None:
        """The accepted keys (rule, key) that keys (rule, key) may meet: those of their buckets; None if there are none."""
        now = self.pointer()
        if now is None or not now["keys"]:
            return None
        rows = keys.select(F.col("rule").cast("int").alias("rule"), "key").where("key IS NOT NULL")
        return self._key_rows(now, [str(r[0]) for r in rows.select(self._key_bucket(now["buckets"]).alias("b")).distinct().collect()])

    def vacuum(self) -> int:
        """Removes the folders and files that the last commit does not name, and returns their number. Nobody may be writing, or reading an earlier version."""
        now = self.pointer()
        live = set() if now is None else {f for fs in now["keys"].values() for f in fs}
        files = set() if now is None else {f["file"] for fs in now["folders"].values() for f in fs}
        system, root = self._file("")
        gone = 0
        for version in system.listStatus(root):
            if version.getPath().getName()[:2] in ("v-", "k-"):
                for part in system.listStatus(version.getPath()):
                    at = f"{version.getPath().getName()}/{part.getPath().getName()}"
                    if not part.isDirectory() or at in live:
                        continue
                    lost = [f.getPath() for f in system.listStatus(part.getPath()) if f"{at}/{f.getPath().getName()}" not in files]
                    if len(lost) == len(system.listStatus(part.getPath())):
                        lost = [part.getPath()]
                    for path in lost:
                        system.delete(path, True)
                        gone += 1
        return gone


def _inside(path: str) -> str:
    """A file of a table by its place in the table's folder: version, bucket and name."""
    return "/".join(urllib.parse.unquote(path).split("/")[-3:])


def _name(name: str) -> str:
    """A column or an unqualified table name as a quoted identifier."""
    return '"' + name.replace('"', '""') + '"'


def _connection(spark: SparkSession, url: str, properties: dict[str, str]):
    info = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        info.setProperty(k, v)
    return spark._jvm.java.sql.DriverManager.getConnection(url, info)


def key_problems(spark: SparkSession, url: str, table: str, key: str, properties: dict[str, str] | None = None) -> list[str]:
    """What keeps a column of a relational table from being an upsert key: it must exist, hold no nulls, and be unique by itself."""
    connection = _connection(spark, url, properties or {})
    try:
        data = connection.getMetaData()
        columns = data.getColumns(None, None, table, key)
        if not columns.next():
            return [f"The destination has no column '{key}'."]
        found = [] if columns.getString("IS_NULLABLE") == "NO" else [f"The destination key column '{key}' must not allow nulls."]
        indexes = data.getIndexInfo(None, None, table, True, False)
        members: dict[str, list[str]] = {}
        while indexes.next():
            members.setdefault(indexes.getString("INDEX_NAME"), []).append(indexes.getString("COLUMN_NAME"))
        if [key] not in members.values():
            found.append(f"The destination key column '{key}' must have a unique index of its own.")
        return found
    finally:
        connection.close()


def upsert_jdbc(batch: DataFrame, url: str, table: str, key: str, properties: dict[str, str] | None = None, staging: str | None = None) -> UpsertResult:
    """Upserts into a relational table in one statement from a staging table, in one transaction; other columns keep their values.

    The table is named as the database spells it. The staging table goes, whatever happens.
    """
    spark, props = batch.sparkSession, properties or {}
    stage = staging or f"STAGE_{uuid.uuid4().hex[:12].upper()}"
    batch.write.jdbc(url, stage, mode="overwrite", properties=props)
    connection = _connection(spark, url, props)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        target, k = _name(table), _name(key)
        q = [_name(c) for c in batch.columns]
        rest = [c for c in q if c != k]
        count = statement.executeQuery(f"SELECT COUNT(*) FROM {target} t WHERE EXISTS (SELECT 1 FROM {stage} s WHERE s.{k} = t.{k})")
        count.next()
        updated = count.getLong(1)
        sets = ", ".join(f"{c} = s.{c}" for c in rest)
        matched = f"WHEN MATCHED THEN UPDATE SET {sets} " if rest else ""
        touched = statement.executeUpdate(f"MERGE INTO {target} t USING {stage} s ON t.{k} = s.{k} {matched}WHEN NOT MATCHED THEN INSERT ({', '.join(q)}) VALUES ({', '.join(f's.{c}' for c in q)})")
        connection.commit()
        return UpsertResult(touched - updated if rest else touched, updated, None)
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.createStatement().executeUpdate(f"DROP TABLE {stage}")
        connection.commit()
        connection.close()
