"""Files and tables in and out."""

import io
import random
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from rowmill import queries
from rowmill.operators import schema
from rowmill.plans.spec import FieldMapping, Pipeline, SourceOptions, Transformation
from rowmill.sinks.error_report import write_report
from rowmill.sinks.upsert import VersionedTable, key_problems, map_columns, merged, upsert_jdbc
from rowmill.sources import documents
from rowmill.sources.delimited import read_delimited
from rowmill.sources.order import with_row_numbers
from rowmill.sources.relational import ranges_of as key_ranges
from rowmill.sources.relational import read_numbered, read_table
from rowmill.sources.workbook import book_of, book_of_sheets, read_sheets, read_workbooks, sheet_rows
from rowmill.streaming.batches import progress, run_stream


def test_delimited_tells_empty_from_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfa,b,c\r\n1,,"x\r\ny"\r\n\r\n2,""\r\n3\r\n"q,1","he said ""hi""",z\r\n')
    rows = read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True).orderBy("_position").collect()
    assert [(r["a"], r["b"], r["c"]) for r in rows] == [("1", "", "x\ny"), ("2", "", None), ("3", None, None), ("q,1", 'he said "hi"', "z")]


def test_delimited_refuses_bad_files(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("a;b\n1;2;3\n")
    with pytest.raises(Exception, match="more fields"):
        read_delimited(spark, str(tmp_path / "wide.csv"), SourceOptions(delimiter=";")).collect()
    (tmp_path / "twice.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="duplicate"):
        read_delimited(spark, str(tmp_path / "twice.csv"))


def _csv(rows, breaks="\n"):
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\r\n') else v
    return "".join(",".join(map(quoted, r)) + breaks for r in rows)


@pytest.fixture
def ranges_of(spark):
    """Sets the bytes of a range."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size):
        for k, v in zip(kept, (size, 1)):
            spark.conf.set(k, str(v))

    yield to
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_records_cross_ranges(spark, tmp_path, ranges_of):
    r = random.Random(4)
    for breaks in ("\n", "\r\n"):
        rows = [[str(i), *("".join(r.choice(["a", "é", '"', "\n", "\r\n", ",", " ", "b" * 9]) for _ in range(r.randint(0, 30))) for _ in range(2))] for i in range(40)]
        rows[20][1] = '\n"long"\n' * 60  # over several ranges
        folder = tmp_path / str(len(breaks))
        folder.mkdir()
        (folder / "a.csv").write_bytes(_csv([["id", "x", "y"], *rows], breaks).encode())
        (folder / "b.csv").write_bytes(_csv([["y", "id", "x"], ["3", "1", "2\n"]], breaks).encode())
        ranges_of((folder / "a.csv").stat().st_size // 25)
        found = read_delimited(spark, str(folder)).orderBy("_file", "_position").collect()
        assert [[f["id"], f["x"], f["y"]] for f in found] == [*rows, ["1", "2\n", "3"]]
        one = read_delimited(spark, str(folder / "a.csv"), multi_line=True).orderBy("_position").collect()
        assert [[f[c].replace("\r\n", "\n") for c in ("id", "x", "y")] for f in one] == [[v.replace("\r\n", "\n") for v in row] for row in rows]


def test_ranges_that_begin_in_quotes(spark, tmp_path, ranges_of):
    """Every width of range over a short text: the cuts fall on each of its characters."""
    text = _csv([["k", "v"], ["1", 'a"\n\n"b'], ["2", ""], ["", "\n"], ["4", "x,y"]])
    (tmp_path / "a.csv").write_text(text)
    for size in (5, 8, 13):
        ranges_of(size)
        found = read_delimited(spark, str(tmp_path / "a.csv")).orderBy("_position").collect()
        assert [(f["k"], f["v"]) for f in found] == [("1", 'a"\n\n"b'), ("2", ""), ("", "\n"), ("4", "x,y")]
    ranges_of(3)  # a range that holds less than the header
    with pytest.raises(ValueError, match="header"):
        (tmp_path / "b.csv").write_text('"long\nname",v\n1,2\n')
        read_delimited(spark, str(tmp_path / "b.csv"))


def test_malformed_text_fails(spark, tmp_path):
    for n, (text, why) in enumerate({'a,b\n2,"open\n3,4\n': "not closed", 'a,b\n1,"bad" tail\n': "malformed", 'a,b\n1,in "side"\n': "malformed", 'a,b\n1,x"y\n2,z"w\n': "malformed", "a,b\n1,2,3\n": "more fields"}.items()):
        path = tmp_path / f"{n}.csv"
        path.write_text(text)
        with pytest.raises(Exception, match=why):
            read_delimited(spark, str(path)).collect()
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("id,name\n1,2\n")
    (tmp_path / "two" / "b.csv").write_text("id,title\n1,2\n")
    with pytest.raises(ValueError, match="other fields"):
        read_delimited(spark, str(tmp_path / "two"))
    (tmp_path / "cr.csv").write_bytes(b"a,b\r1,2\r\r3,4")
    # carriage returns alone end records, too
    assert [tuple(r)[:2] for r in read_delimited(spark, str(tmp_path / "cr.csv")).orderBy("_position").collect()] == [("1", "2"), ("3", "4")]


def workbook(path, rows):
    cells = "".join("<row>" + "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>" for v in r) + "</row>" for r in rows)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["k", "v"], ["x", 1.5], [None, None], ["y"]])
    workbook(tmp_path / "b.xlsx", [["k", "v"], ["", 2]])
    rows = read_workbooks(spark, str(tmp_path), "data", ["k", "v"]).orderBy("_file", "_row_number").collect()
    assert [(r["k"], r["v"], r["_row_number"]) for r in rows] == [("x", "1.5", 2), ("y", None, 3), ("", "2", 2)]


def test_documents_keep_their_kinds(spark):
    df = spark.createDataFrame([(1, '{"a": 7, "b": "x"}'), (2, '{"a": null}')], "id long, j string")
    rows = documents.shape(documents.documents(df, "j", "id"), [("a", "Integer"), ("b", "String")]).orderBy("id").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(7, "x"), (None, None)]
    for bad in ('{"a": "7"}', '{"a": 1.5}', '{"c": 1}', '{"a": [1]}'):
        one = spark.createDataFrame([(1, bad)], "id long, j string")
        with pytest.raises(Exception, match="schema has changed"):
            documents.shape(documents.documents(one, "j", "id"), [("a", "Integer"), ("b", "String")]).collect()


def test_row_numbers_follow_the_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    rows = with_row_numbers(df, ["k"], start=2).collect()
    assert all(r["_row_number"] == r["k"] + 2 for r in rows) and len(rows) == 1000


def test_versioned_upserts(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    done = table.upsert(first, batch_id=0)
    assert (done.inserted, done.updated) == (2, 0)
    second = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    done = table.upsert(second, batch_id=1)
    assert (done.inserted, done.updated) == (1, 1)
    assert (table.upsert(second, batch_id=1).inserted, table.upsert(second, batch_id=1).updated) == (0, 0)
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_upserts_leave_other_buckets_alone(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k", buckets=4)
    table.upsert(spark.createDataFrame([(i, 0) for i in range(100)], "k long, v int"))
    before = table.pointer()["folders"]
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    table.upsert(spark.createDataFrame([(7, 1, "x")], "k long, v int, w string"))
    after = table.pointer()["folders"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert all(p.stat().st_mtime_ns == t for p, t in stamps.items())
    assert table.vacuum() == 1 and table.vacuum() == 0
    rows = {r["k"]: (r["v"], r["w"]) for r in table.read().collect()}
    assert len(rows) == 100 and rows[7] == (1, "x") and rows[8] == (0, None)


def test_upsert_modes_and_mapping(spark):
    target = spark.createDataFrame([("a", 1, "x")], "k string, v int, w string")
    batch = spark.createDataFrame([("a", 2)], "k string, v int")
    assert merged(target, batch, "k", "replace").first()["w"] is None
    assert merged(target, batch, "k", "update_columns").first()["w"] == "x"
    with pytest.raises(ValueError):
        map_columns(batch, (FieldMapping("v", "v"),), "k", ["k", "v"])


def test_jdbc_source_and_upsert(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(i, f"n{i}", 1.0 * i) for i in range(1, 11)], "ID long, NAME string, AMOUNT double").write.jdbc(url, "CUSTOMER")
    assert read_table(spark, url, "CUSTOMER", "ID", partitions=3).count() == 10
    done = upsert_jdbc(spark.createDataFrame([(10, "new"), (11, "eleven")], "ID long, NAME string"), url, "CUSTOMER", "ID")
    assert (done.inserted, done.updated) == (1, 1)
    rows = {r["ID"]: (r["NAME"], r["AMOUNT"]) for r in read_table(spark, url, "CUSTOMER", "ID").collect()}
    assert rows[10] == ("new", 10.0) and rows[11] == ("eleven", None)


def test_relational_ranges_of_any_key(spark, tmp_path):
    """Keys of text and of two columns, with nulls and quotes: every row once, numbered in the key's order."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(f"it's {i % 4}", i, f"v{i}") for i in range(40)]
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().executeUpdate("CREATE TABLE T (A VARCHAR(20), B INT, V VARCHAR(20))")
    for a, b, v in [*rows, (None, 99, "null")]:
        connection.createStatement().executeUpdate(f"INSERT INTO T VALUES ({'NULL' if a is None else repr(a.replace(chr(39), '`'))}, {b}, '{v}')".replace("`", "''"))
    connection.close()
    for key in (["A", "B"], ["B"], "V"):
        df = read_table(spark, url, "T", key, partitions=5)
        assert df.rdd.getNumPartitions() > 1 and sorted(r["B"] for r in df.collect()) == [*range(40), 99]
    numbered = read_numbered(spark, url, "T", "B", partitions=3).collect()
    assert all(r["_row_number"] == min(r["B"], 40) + 1 for r in numbered)


def test_destination_keys(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(1).select(F.col("id").alias("ID")).write.jdbc(url, "LOOSE")
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().executeUpdate('CREATE TABLE FIRM (ID BIGINT NOT NULL PRIMARY KEY, B INT)')
    connection.close()
    assert key_problems(spark, url, "FIRM", "ID") == [] and len(key_problems(spark, url, "FIRM", "B")) == 2
    assert key_problems(spark, url, "FIRM", "C") == ["The destination has no column 'C'."] and key_problems(spark, url, "LOOSE", "ID")


def test_dates_in_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book_of("Data", ["k", "day", "ok"], [("a", 35897, True), ("b", 35897.75, False), ("c", None, None)], dated=(1,)))
    rows = read_workbooks(spark, str(tmp_path), "Data", ["k", "day", "ok"]).orderBy("_row_number").collect()
    assert [(r["k"], r["day"], r["ok"]) for r in rows] == [("a", "1998-04-12", "TRUE"), ("b", "1998-04-12 18:00:00", "FALSE"), ("c", None, None)]


def test_worksheets_of_many_files(spark, tmp_path):
    for i in range(3):
        sheets = {"In": [("k", "v", "d"), (f"a{i}", 1.5, 35897), (None, None, None), (f"b{i}", "x", None)], "Out": [("k", "v", "d"), (f"c{i}", True, 35898)], "Else": [("z",)]}
        (tmp_path / f"{i}.xlsx").write_bytes(book_of_sheets(sheets, dated=(2,)))
    (tmp_path / "notes.txt").write_text("no workbook")
    cells = read_sheets(spark, str(tmp_path), ["in", "OUT"], ["k", "v", "d"])
    assert cells.rdd.getNumPartitions() == 6  # files x worksheets
    want = sorted(r for i in range(3) for r in [("in", 2, f"a{i}", "1.5", "1998-04-12"), ("in", 3, f"b{i}", "x", None), ("OUT", 2, f"c{i}", "TRUE", "1998-04-13")])
    assert sorted((r["_sheet"], r["_row_number"], r["k"], r["v"], r["d"]) for r in cells.collect()) == want
    # of one column: the same rows and numbers
    assert sorted((r["_sheet"], r["_row_number"], r["d"]) for r in read_sheets(spark, f"file://{tmp_path}", ["in", "OUT"], ["k", "v", "d"], fields=["d"]).collect()) == sorted((s, n, d) for s, n, _, _, d in want)
    typed = read_sheets(spark, str(tmp_path / "0.xlsx"), ["In"], ["k", "v", "d"], typed=True, fields=["d", "v"]).orderBy("_row_number")
    assert [str(r["v"].toPython()) for r in typed.collect()] == ["1.5", "x"] and typed.columns == ["d", "v", "_file", "_sheet", "_row_number"]
    assert read_sheets(spark, str(tmp_path), ["Else"], ["z"]).count() == 0
    with pytest.raises(Exception, match="no worksheet 'Lost'"):
        read_sheets(spark, str(tmp_path), ["In", "Lost"], ["k", "v", "d"]).collect()
    with pytest.raises(Exception, match="the header is"):
        read_sheets(spark, str(tmp_path), ["In"], ["v", "k", "d"]).collect()
    with pytest.raises(ValueError, match="no fields"):
        read_sheets(spark, str(tmp_path), ["In"], ["k"], fields=["q"])
    (tmp_path / "empty").mkdir()
    assert read_sheets(spark, str(tmp_path / "empty"), ["In"], ["k"]).count() == 0


def test_long_worksheet_is_read_as_a_stream(tmp_path):
    n = 500_000
    rows = "".join(f'<row><c><v>{i}</v></c><c t="s"><v>{i}</v></c></row>' for i in range(n))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    book = book_of("Data", ["a", "b"], [])
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(tmp_path / "a.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        for name in old.namelist():
            if name not in ("xl/worksheets/sheet1.xml", "xl/sharedStrings.xml"):
                z.writestr(name, old.read(name))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>text {i} with some length</t><rPh><t>hint</t></rPh></si>" for i in range(n)) + "</sst>")
    # in a process of its own, whose peak tells what the read holds
    code = """
import resource, sys
from rowmill.sources.workbook import sheet_rows
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
before = peak()
with open(sys.argv[1], "rb") as file:
    for count, cells in enumerate(sheet_rows(file, "data"), 1):
        pass
print(count, cells[0], cells[1], (peak() - before) // 1024, sep="|")
"""
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path / "a.xlsx")], capture_output=True, text=True, check=True).stdout
    count, number, text, grown = out.strip().split("|")
    assert (int(count), number, text) == (n, str(n - 1), f"text {n - 1} with some length")
    assert int(grown) < 60  # MB; the texts and their places are 19 of it


def test_report_files(spark, tmp_path):
    queries.error_report_rows(spark, "/root/testdata/sf0.001").withColumnRenamed("row_number", "SourceRowNumber").transform(lambda df: write_report(df, str(tmp_path / "r")) or df)
    content = b"".join(p.read_bytes() for p in sorted((tmp_path / "r").glob("*.csv")))
    assert b"\r\n" in content


def test_stream_in_batches(spark, tmp_path):
    for i, rows in enumerate([[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")]]):
        spark.createDataFrame(rows, "n long, k string").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    source = spark.readStream.schema("n long, k string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    pipeline = Pipeline("s", (("n", "Integer"), ("k", "String")), (FieldMapping("n", "n"), FieldMapping("k", "k")), "k", (Transformation("Trim", 1, "k"),))
    table = VersionedTable(spark, str(tmp_path / "out"), "k")
    run_stream(spark, source, pipeline, "n", table, str(tmp_path / "cp"))
    assert {r["k"] for r in table.read().collect()} == {"a", "b", "c"}
    counts = progress(spark, table).agg(F.sum("processed"), F.sum("valid"), F.sum("duplicate"), F.sum("inserted"), F.sum("updated")).first()
    assert tuple(counts) == (5, 3, 2, 3, 0)


def test_all_keys_carry_over_between_batches(spark, tmp_path):
    rows = [[(1, "a", "x", None), (2, "b", "x", "1"), (3, "c", "y", "1")], [(4, "d", "y", "2"), (5, "a", "z", "3"), (6, "e", "z", "4"), (7, "f", "w", None)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "n long, k string, u string, v string").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    names = ("n", "k", "u", "v")
    pipeline = Pipeline("s", tuple((c, "String") for c in names), tuple(FieldMapping(c, c) for c in names), "k", (Transformation("Deduplicate", 1, None, {"Fields": ["u"]}), Transformation("Deduplicate", 2, None, {"Fields": ["v"]})))
    source = spark.readStream.schema("n long, k string, u string, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = {}
    run_stream(spark, source, pipeline, "n", VersionedTable(spark, str(tmp_path / "out"), "k"), str(tmp_path / "cp"), lambda _, b: seen.update({r["_row_number"]: r["_status"] for r in b.collect()}))
    # 2 repeats u; 4 repeats u of 3; 5 repeats the upsert key of 1 and so takes nothing; 7 repeats the null v of 1
    assert [seen[i] for i in range(1, 8)] == ["Valid", "Duplicate", "Valid", "Duplicate", "Duplicate", "Valid", "Duplicate"]


def test_ranges_take_two_queries(spark, tmp_path, monkeypatch):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([((i * 7919) % 1000, i % 3, f"n{i:04d}") for i in range(1000)], "ID long, PART int, NAME string").write.option("createTableColumnTypes", "NAME VARCHAR(20)").jdbc(url, "WIDE")
    asked, reader = [], type(spark.read)
    real = reader.jdbc
    monkeypatch.setattr(reader, "jdbc", lambda self, url, table, *a, **k: (asked.append(table), real(self, url, table, *a, **k))[1])
    ranges = key_ranges(spark, url, "WIDE", ["ID"], partitions=40)
    assert len(asked) == 2 and ranges.bounds == tuple((i,) for i in range(25, 1000, 25)) and ranges.before == tuple(range(25, 1000, 25))
    for key in ("ID", ["PART", "ID"]):
        rows = read_numbered(spark, url, "WIDE", key, partitions=7).collect()
        by = (lambda r: r["ID"]) if key == "ID" else lambda r: (r["PART"], r["ID"])
        assert [r["_row_number"] for r in sorted(rows, key=by)] == list(range(1, 1001))
    text = read_numbered(spark, url, "WIDE", "NAME", partitions=7).collect()
    assert [r["_row_number"] for r in sorted(text, key=lambda r: r["NAME"])] == list(range(1, 1001))
    assert read_numbered(spark, url, "WIDE", "ID", partitions=7).where("ID = 500").first()["_row_number"] == 501
    assert read_table(spark, url, "WIDE", "ID", partitions=1).count() == 1000 and key_ranges(spark, url, "(SELECT * FROM WIDE WHERE ID < 0) w", ["ID"]).predicates() == []


def test_documents_with_conflicts_fail(spark):
    docs = lambda *texts: documents.documents(spark.createDataFrame([(t,) for t in texts], "j string"), "j")
    assert dict(map(tuple, schema.document_schema(docs('{"a": 1, "b": "x"}', '{"a": 1.5}'), strict=True).collect())) == {"a": "Decimal", "b": "String"}
    assert dict(map(tuple, schema.document_schema(docs('{"a": 1}', '{"a": "x"}')).collect())) == {"a": "Error"}
    for texts, why in ((('{"a": 1}', '{"a": "x"}'), "no type in common"), (('{"a": {"b": 1}}',), "no type in common"), (('{" ": 1}',), "blank name")):
        with pytest.raises(Exception, match=why):
            schema.document_schema(docs(*texts), strict=True).collect()
