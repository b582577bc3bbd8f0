"""A training corpus from raw documents: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm import decontaminate, line_dedup, minhash_dedup, packing, toxicity
from rowmill.llm.frames import sized, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    Each row is judged by its whole text, repeated rows alike; null and empty texts have the score of no words and stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(model, F.col("text")) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line equals or is one edit from; documents left without a word go.

    Null and empty texts, and texts of blanks that lose no line, stay as they are. Rows that repeat a doc_id are one document: what goes, by position, goes from
    each. n_chars follows the text.
    """
    cleaned = line_dedup.without_lines(docs, line_dedup.removed_lines(docs))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group whose five-word shingles are 0.8 similar.

    Texts without words stay. Of rows that repeat a doc_id and are alike, one stays; rows of a kept doc_id with other texts stay with it.
    """
    result = minhash_dedup.minhash_dedup(docs)
    gone = result.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    again = written(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("again_id")).agg(F.count("*").alias("n")).where("n > 1").select("again_id"), "repeated-ids")
    if again.limit(1).count():
        once = docs.join(again, docs["doc_id"] == again["again_id"], "left_semi").dropDuplicates(["doc_id", "text"])
        docs = docs.join(again, docs["doc_id"] == again["again_id"], "left_anti").unionByName(once)
    return sized(docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, whole or paraphrased. Null and empty texts hold none; repeated rows are judged each."""
    found = decontaminate.with_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__items")
    return found.where(F.size("__items") == 0).drop("__items")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences. A null or empty text is the end token alone; each of repeated rows is packed."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained models, near-duplicate groups and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
