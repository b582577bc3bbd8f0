"""Line-first quality rules, in DataFrame expressions only.

Each line is judged by itself: lines of navigation, boilerplate, or fragments without end punctuation fail and are
removed; a document that loses too much of its text with them is rejected. All work stays in
one projection without a shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.frames import WORD, text_of

SPACES = r"[\x20\x09-\x0D]+"
#: End punctuation; closing quotes and brackets may follow.
PUNCTUATED = r"[.!?:;,…。！？][\"'”’»)\]*#$%&]*[\x20\x09-\x0D]*$"
#: Links or cells in a row.
SEPARATED = r"(?:[^|»›·•]{1,24}[|»›·•]){3}"
#: Words that shout.
SHOUTED = r"(?:!![\x20\x09-\x0D].*){3}"
#: Fixed phrases of boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript", "lorem ipsum",
    "subscribe to our", "click here", "back to top", "sign in to", "licensed under the", "released under the",
)


def line_fails(line: Column, fragment_words: int) -> Column:
    """Whether a line is to be removed: navigation, a table, shouting, symbols, boilerplate, or a short fragment without end punctuation."""
    short = ~line.rlike(rf"({WORD}+{SPACES}){{{fragment_words - 1}}}{WORD}")
    low = F.lower(line)
    boilerplate = reduce(or_, (F.contains(low, F.lit(x)) for x in BOILERPLATE))
    return (
        (line.rlike("[|»›·•]") & line.rlike(SEPARATED))
        | (F.contains(line, F.lit("!!")) & line.rlike(SHOUTED))
        | (10 * F.regexp_count(line, F.lit("[#*$%&|<>]")) > F.char_length(line))
        | boilerplate
        | (short & ~line.rlike(PUNCTUATED))
    )


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat: int = 50, fragment_words: int = 5, max_lost: float = 0.5) -> DataFrame:
    """Judges every document by its lines.

    Returns doc_id, cleaned (text without the failed lines), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_failed_lines, lost (part of the characters of lines that failed), base_failed (fewer than min_words words,
    or over max_repeat percent of them in repeated 3-word windows) and kept (not base_failed, and lost is not above max_lost).
    A null text is empty and fails. Rows are judged one by one, so repeated rows and null ids stay as they are. Other columns
    are ignored. An empty table gives an empty one.
    """
    # Each step is a column of its own and used more than once behind, so that lambdas read it and don't compute it again.
    d = text_of(docs).withColumns({"words": F.array_remove(F.split("text", SPACES), ""), "lines": F.split("text", "\n", -1)})
    n = F.size("words")
    d = d.withColumns(
        {
            "grams": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>")),
            "live": F.filter("lines", lambda x: x.rlike(WORD)),
            "failed": F.transform("lines", lambda x: line_fails(x, fragment_words) & x.rlike(WORD)),
        }
    )
    d = d.withColumn("ranked", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.arrays_zip(F.col("grams").alias("h"), F.sequence(F.lit(0), F.size("grams") - 1).alias("i")))))
    same = lambda k, other: F.get("ranked", k)["h"] == F.get("ranked", other)["h"]
    d = d.withColumn(
        "repeats",
        F.when(
            F.col("ranked").isNotNull(),
            F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("ranked") - 1), lambda k: F.coalesce(same(k, k + 1), F.lit(False)) | F.coalesce(same(k, k - 1), F.lit(False))), lambda k: F.get("ranked", k)["i"])),
        ),
    )
    gap = lambda k: F.coalesce(F.get("repeats", k + 1) - F.get("repeats", k), F.lit(3))
    repeat_words = F.coalesce(F.aggregate(F.sequence(F.lit(0), F.size("repeats") - 1), F.lit(0), lambda acc, k: acc + F.least(F.lit(3), gap(k))), F.lit(0))
    chars = lambda x: F.aggregate(x, F.lit(0), lambda acc, y: acc + F.char_length(y))
    lost_lines = F.filter("lines", lambda x, i: F.get("failed", i))
    d = d.select(
        "doc_id",
        F.array_join(F.filter("lines", lambda x, i: ~F.get("failed", i)), "\n").alias("cleaned"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("live") - F.size(F.array_distinct("live"))).cast("long").alias("n_dup_lines"),
        repeat_words.cast("long").alias("n_repeat_words"),
        F.size(F.filter("failed", lambda x: x)).cast("long").alias("n_failed_lines"),
        (chars(lost_lines) / F.greatest(F.lit(1), chars(F.col("lines")))).alias("lost"),
    )
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return d.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & (F.col("lost") <= max_lost))


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
