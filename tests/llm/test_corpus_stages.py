"""The corpus pipeline: each stage's decisions, and registration."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from rowmill.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"


def docs(spark, extra=()):
    r = random.Random(1)

    def text(n):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in range(n)) + "."

    rows = [(i, "\n".join(text(20) for _ in range(5)), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[3][1], "en", "s", 0), (101, rows[4][1] + "\n" + text(9), "en", "s", 0), (102, None, None, None, None), (103, "", "en", "s", 0), *extra]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "decontamination", "packing"]
    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in queries.queries()}


def test_line_stage_keeps_columns_and_clean_documents(spark):
    df = docs(spark)
    out = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    assert 100 not in out  # all its lines stand in 3
    assert out[3]["text"] == df.where("doc_id = 3").first()["text"] and out[101]["text"].count("\n") == 0
    assert out[102]["text"] is None and out[103]["text"] == "" and len(out) == 63
    assert out[5]["n_chars"] == len(out[5]["text"])


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    df = docs(spark)
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in df.collect()} - {100, 101}


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 1024
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0.5 * n < len({r["doc_id"] for r in rows}) <= n


def test_lines_of_repeated_rows(spark):
    df = docs(spark, [(1, "a b c d e f g h", "en", "s", 8)] * 2)
    assert line_dedup.without_lines(df, line_dedup.removed_lines(df)).where("doc_id = 1").count() >= 1


CLASHING = ("score", "kept", "component_id", "gone_id", "again_id", "n", "line", "key", "items", "item_id", "passage", "word", "start", "length", "sequence_id")


def test_stages_on_empty_tables_long_texts_and_clashing_names(spark):
    r = random.Random(2)
    long_text = "\n".join(" ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(12)) + "." for _ in range(2_000))
    plain = docs(spark, [(200, long_text, "en", "s", len(long_text)), (None, "words of nobody that stand here alone.", "en", "s", 0)])
    df = plain.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        rows = {row["doc_id"]: row for row in out.collect()}
        assert {102, 103, 200, 5} <= set(rows) and rows[200]["text"] == long_text, name
        assert all(rows[200][c] == f"own {c}" for c in CLASHING), name
        assert stage(spark, df.where("false"), SF).collect() == [], name
    pieces = corpus_pipeline.pack_sequences(spark, df, SF).collect()
    assert {row["doc_id"] for row in pieces} == {row["doc_id"] for row in plain.select("doc_id").collect()}
    assert len([row for row in pieces if row["doc_id"] == 200]) > 50 and max(row["offset"] + row["length"] for row in pieces) <= 1024
    assert corpus_pipeline.pack_sequences(spark, df.where("false"), SF).collect() == []
