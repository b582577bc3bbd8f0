"""The log of commits: writers that die, writers that meet, and streams that go on."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from rowmill import queries
from rowmill.plans.compiler import compile_rows
from rowmill.plans.spec import FieldMapping, Pipeline, Transformation
from rowmill.sinks.upsert import Conflict, VersionedTable
from rowmill.streaming.batches import progress, run_stream

KEYED = Pipeline("p", (("k", "Integer"), ("v", "Integer")), (FieldMapping("k", "k"), FieldMapping("v", "v")), "k", (Transformation("Deduplicate", 1, config={"Fields": ["v"]}),))


class Died(RuntimeError):
    pass


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v long")


def test_a_writer_that_dies_before_its_commit(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), "k", buckets=2)
    table.upsert(frame(spark, [(1, 1), (2, 2)]), batch_id=0, counters={"processed": 2})
    commit = VersionedTable._committed
    monkeypatch.setattr(VersionedTable, "_committed", lambda *a: (_ for _ in ()).throw(Died()))
    with pytest.raises(Died):
        table.upsert(frame(spark, [(1, 9), (3, 3)]), batch_id=1, counters={"processed": 2})
    monkeypatch.setattr(VersionedTable, "_committed", commit)
    assert sorted(map(tuple, table.read().collect())) == [(1, 1), (2, 2)] and table.numbers() == [1]
    done = table.upsert(frame(spark, [(1, 9), (3, 3)]), batch_id=1, counters={"processed": 2})
    assert (done.inserted, done.updated) == (1, 1) and table.vacuum() > 0
    assert sorted(map(tuple, table.read().collect())) == [(1, 9), (2, 2), (3, 3)]
    assert [tuple(r)[:2] for r in progress(spark, table).orderBy("batch_id").collect()] == [(0, 2), (1, 2)]


def test_a_stream_that_dies_around_a_commit_loses_no_progress(spark, tmp_path, monkeypatch):
    for n in range(3):
        frame(spark, [(n * 10 + i, n * 10 + i) for i in range(4)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    source = lambda: spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = VersionedTable(spark, str(tmp_path / "t"), "k", buckets=2)
    commit, seen = VersionedTable._committed, []

    def dying(self, entry):
        seen.append(entry["number"])
        if len(seen) == 2:  # before the second commit
            raise Died()
        done = commit(self, entry)
        if len(seen) == 3:  # behind it, when it is repeated
            raise Died()
        return done

    monkeypatch.setattr(VersionedTable, "_committed", dying)
    for _ in range(2):
        with pytest.raises(Exception, match="Died"):
            run_stream(spark, source(), KEYED, "k", table, str(tmp_path / "c"))
    run_stream(spark, source(), KEYED, "k", table, str(tmp_path / "c"))
    rows = progress(spark, table).orderBy("batch_id").collect()
    assert [(r["batch_id"], r["processed"], r["valid"], r["inserted"]) for r in rows] == [(0, 4, 4, 4), (1, 4, 4, 4), (2, 4, 4, 4)]
    assert table.read().count() == 12


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path, "k", buckets=8)
    table.upsert(frame(spark, [(i, 0) for i in range(40)]))
    buckets = {r["k"]: r["b"] for r in spark.range(40).select(F.col("id").alias("k"), F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(8)).alias("b")).collect()}
    apart = next(k for k in buckets if buckets[k] != buckets[0])
    commit = VersionedTable._committed

    def with_rival(rival):
        """The next commit comes behind one of another writer."""
        once = []

        def committed(self, entry):
            if not once:
                once.append(1)
                VersionedTable(spark, path, "k").upsert(frame(spark, rival))
            return commit(self, entry)

        monkeypatch.setattr(VersionedTable, "_committed", committed)

    with_rival([(apart, 5)])  # other buckets: the commit is only moved
    table.upsert(frame(spark, [(0, 1)]))
    with_rival([(0, 7), (100, 7)])  # the same bucket: merged anew
    done = table.upsert(frame(spark, [(0, 2), (100, 3)]))
    assert (done.inserted, done.updated) == (0, 2)
    rows = dict(map(tuple, table.read().collect()))
    assert rows == {i: 0 for i in range(40)} | {0: 2, apart: 5, 100: 3} and table.numbers() == [1, 2, 3, 4, 5]
    monkeypatch.setattr(VersionedTable, "_committed", commit)
    errors = []

    def write(n):
        try:
            VersionedTable(spark, path, "k").upsert(frame(spark, [(200 + n, n), (0, n)]))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = dict(map(tuple, table.read().collect()))
    assert not errors and {200, 201, 202} <= set(rows) and rows[0] in (0, 1, 2)


def test_streams_that_meet(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), "k", buckets=2)
    keys = lambda k: spark.createDataFrame([(0, k)], "rule int, key string")
    table.upsert(frame(spark, [(1, 1)]), batch_id=0, keys=keys("a"))
    commit, once = VersionedTable._committed, []

    def committed(self, entry):
        if not once:
            once.append(1)
            VersionedTable(spark, table.path, "k").upsert(frame(spark, [(2, 2)]), keys=keys("b"))
        return commit(self, entry)

    monkeypatch.setattr(VersionedTable, "_committed", committed)
    with pytest.raises(Conflict):
        table.upsert(frame(spark, [(3, 3)]), batch_id=1, keys=keys("b"))


def test_a_batch_opens_the_buckets_of_its_keys_only(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k", buckets=32)
    keys = spark.range(400).select(F.lit(0).alias("rule"), F.col("id").cast("string").alias("key"))
    for n in range(2):
        table.upsert(frame(spark, [(n, n)]), batch_id=n, keys=keys.where(f"key % 2 = {n}"))
    found = table.taken(keys.where("key = '7'"))
    folders = {f.rsplit("/", 1)[0].rsplit("=", 1)[1] for f in found.inputFiles()}
    assert len(folders) == 1 and found.where("key = '7'").count() == 1 and found.count() < 60
    # a bucket of many folders is put together
    for n in range(2, 12):
        table.upsert(frame(spark, [(n, n)]), batch_id=n, keys=keys.where("key = '7'").select("rule", F.lit(f"x{n % 2}").alias("key")))
    assert max(len(f) for f in table.pointer()["keys"].values()) <= VersionedTable.KEY_FOLDERS + 1


def test_an_upsert_rewrites_the_files_that_hold_its_keys(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k", buckets=2)
    rewritten = lambda: table.pointer()["counters"]["rewritten"]
    files = lambda: {f["file"] for fs in table.pointer()["folders"].values() for f in fs}
    for n in range(3):  # later keys: no file of earlier ones is touched, or looked into
        given = frame(spark, [(n * 100 + i, n) for i in range(100)])
        if n:
            assert table._holding(table.pointer(), given, table._ranges(given, F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(2)))) == []
        done = table.upsert(given)
        assert (done.inserted, done.updated, rewritten()) == (100, 0, 0)
    assert len(files()) == 6
    before = files()
    done = table.upsert(frame(spark, [(150, 7)]))  # of one file of six
    assert (done.inserted, done.updated, rewritten(), len(before & files())) == (0, 1, 1, 5)
    done = table.upsert(frame(spark, [(-5, 7), (500, 7)]))  # a range over all files, but none holds the keys
    assert (done.inserted, done.updated, rewritten()) == (2, 0, 0) and before - files() == before - {*before & files()}
    assert dict(map(tuple, table.read().collect())) == {i: i // 100 for i in range(300)} | {150: 7, -5: 7, 500: 7}
    assert table.vacuum() == 1 and table.read().count() == 302
    for n in range(12):  # many small files of a bucket are put together
        table.upsert(frame(spark, [(1000, n)] if n == 0 else [(1000 + 100 * n, n)]))
    assert max(map(len, table.pointer()["folders"].values())) <= VersionedTable.SMALL_FILES and table.read().count() == 314
    # a column more, with files that lack it left as they are
    more = VersionedTable(spark, str(tmp_path / "m"), "d", buckets=1)
    day = lambda rows, names: spark.createDataFrame(rows, names).withColumn("d", F.to_date("d"))
    more.upsert(day([("2024-01-01", 1)], "d string, v long"))
    more.upsert(day([("2024-01-02", 2, "x")], "d string, v long, w string"), "update_columns")
    assert sorted((str(r["d"]), r["v"], r["w"]) for r in more.read().collect()) == [("2024-01-01", 1, None), ("2024-01-02", 2, "x")] and more.pointer()["counters"]["rewritten"] == 0
    assert more.upsert(day([], "d string, v long")).inserted == 0 and more.read().count() == 2


def test_keys_of_a_callable(spark):
    rows = frame(spark, [(1, 1), (2, 2), (3, 2)])
    taken = spark.createDataFrame([(1, '{"k":2}')], "rule int, key string")
    for given in (taken, lambda keys: taken.join(keys, ["rule", "key"], "left_semi")):
        assert [r["_status"] for r in compile_rows(rows, KEYED, "k", given).orderBy("_row_number").collect()] == ["Valid", "Duplicate", "Valid"]
    assert queries.ORDERS.upsert_key == "o_custkey"
