"""Line dedup by a deletion-neighbourhood join, with words as the units of edits.

Two lines are within one edit (a word inserted, deleted or replaced) if and only if deleting one word at most
from each gives equal lines: at the same place in both for a replacement, in the longer one alone
otherwise. Every candidate line emits its own hash and that of each variant with one word deleted;
equal variants meet in aggregates, which keep the earliest line of each, so no group is ever paired
with itself; edit distance is verified on the words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.frames import WORD, dropped, map_batches, sized, text_of, written
from rowmill.llm.kernels import RunHasher, as_bytes, mix, signed, word_hashes, word_spans
from rowmill.llm.repeats import ids_of, known_id

#: The share of a line's words that an edit may touch: one word in four or more.
MAX_CHANGE = 0.25

_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def line_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of words of each \\n-split line."""
    breaks = np.flatnonzero(data == 0x0A)
    cuts = np.searchsorted(starts, breaks)
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(starts)]])


def variants(units: np.ndarray) -> np.ndarray:
    """Hashes of a line with its word i deleted, and last that of the whole line; comparable between lines."""
    n = len(units)
    hasher = RunHasher(units)
    sums, inverse = hasher.sums, hasher.inverse
    without = sums[:-1] + (sums[n] - sums[1:]) * inverse[1]
    lengths = np.full(n + 1, n - 1, dtype=np.uint64)
    lengths[n] = n
    return mix(np.append(without, sums[n]) ^ lengths * _LENGTH)


def one_edit_apart(a: list[bytes], b: list[bytes]) -> bool:
    """Whether inserting, deleting or replacing one word at most turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _lines(docs: DataFrame, near_words: int) -> DataFrame:
    """doc, pos, h1, h2 (the line's words) of lines with a word, and for those of near_words or more the
    keys half1..half4, of which two lines one edit apart have one in common: an edit leaves the
    first or the last p words alone, where p is half the greatest power of two up to the length of
    both. A length that is a power of two also takes the p of the length below."""

    def run(batch: pa.RecordBatch):
        rows = []
        ids = ids_of(batch)
        raw = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column("text")]
        # documents are joined into chunks that stay in a core's cache; a line break between them keeps their lines apart
        chunk = np.cumsum([len(x) + 1 for x in raw]) // 32768
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(raw)]
        for low, high in zip(cuts, cuts[1:]):
            data = np.frombuffer(b"\n".join(raw[low:high]), dtype=np.uint8)
            starts, ends = word_spans(data)
            units = word_hashes(data, starts, ends)
            first, end = line_bounds(data, starts)
            of_each = np.array([x.count(b"\n") + 1 for x in raw[low:high]])
            doc_of = np.repeat(ids[low:high], of_each)
            pos_of = np.arange(len(first)) - np.repeat(np.cumsum(of_each) - of_each, of_each)
            pos = np.flatnonzero(end > first)
            if not len(pos):
                continue
            first, end = first[pos], end[pos]
            hasher, other = RunHasher(units), RunHasher((units ^ (units >> np.uint64(29))) * _LENGTH)
            n = end - first
            level = np.frexp(n.astype(float))[1] - 1
            halves = []
            for back in (0, 1):
                p = np.minimum(n, 1 << np.maximum(level - 1 - back, 0))
                salt = ((level - back) * 2).astype(np.uint64)
                halves += [mix(hasher.runs(first, first + p) ^ salt), mix(hasher.runs(end - p, end) ^ (salt + np.uint64(1)))]
            near = n >= near_words
            nulls = [~near, ~near, ~(near & (n == 1 << level)), ~(near & (n == 1 << level))]
            rows.append((doc_of[pos], pos_of[pos].astype(np.int32), signed(hasher.runs(first, end)), signed(other.runs(first, end)), *map(signed, halves), *nulls))
        if rows:
            cols = [np.concatenate(x) for x in zip(*rows)]
            names = ["doc", "pos", "h1", "h2", "half1", "half2", "half3", "half4"]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols[:4]] + [pa.array(x, mask=m) for x, m in zip(cols[4:8], cols[8:])], names=names)

    return map_batches(docs, run, "doc long, pos int, h1 long, h2 long, half1 long, half2 long, half3 long, half4 long")


def _candidate_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc, pos, line of the given places."""
    wanted = places.groupBy("doc").agg(F.collect_list("pos").alias("wanted"))

    def run(batch: pa.RecordBatch):
        for doc, text, wanted in zip(*(batch.column(x) for x in ("doc", "text", "wanted"))):
            lines = text.as_py().split("\n")
            pos = [p for p in wanted.as_py() if p < len(lines)]
            yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(pos), pa.int64()), pa.array(pos, pa.int32()), pa.array([lines[p] for p in pos], pa.string())], names=["doc", "pos", "line"])

    texts = docs.select(known_id(docs).alias("id"), "text").join(wanted, F.col("id") == F.col("doc")).select("doc", "text", "wanted")
    return map_batches(texts, run, "doc long, pos int, line string")


def _neighbours(lines: DataFrame, near_words: int, name: str) -> DataFrame:
    """Pairs (doc, pos, by_doc, by_pos) of distinct lines and an earlier one that shares a variant."""

    def run(batch: pa.RecordBatch):
        rows = []
        for doc, pos, line in zip(*(batch.column(x) for x in ("doc", "pos", "line"))):
            data = as_bytes(line.as_py())
            starts, ends = word_spans(data)
            if len(starts) < near_words:
                continue
            hashes = signed(variants(word_hashes(data, starts, ends)))
            places = np.arange(len(hashes), dtype=np.int32)
            places[-1] = -1
            rows.append((hashes, places, np.full(len(hashes), doc.as_py()), np.full(len(hashes), pos.as_py(), dtype=np.int32)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], names=["variant", "deleted", "doc", "pos"])

    each = written(map_batches(lines, run, "variant long, deleted int, doc long, pos int"), f"{name}-variants")
    least = written(
        each.groupBy("variant", "deleted").agg(F.min(F.struct("doc", "pos")).alias("at"), F.count("*").alias("n")).where("n > 1 or deleted < 0").select("variant", "deleted", F.col("at.doc").alias("by_doc"), F.col("at.pos").alias("by_pos")),
        f"{name}-least",
    )
    replaced = each.where("deleted >= 0").join(least.where("deleted >= 0"), ["variant", "deleted"])
    whole = least.where("deleted < 0").drop("deleted")
    longer = written(each.where("deleted >= 0").join(whole, "variant").select("doc", "pos", "by_doc", "by_pos"), f"{name}-longer")
    turned = longer.select(F.col("by_doc").alias("doc"), F.col("by_pos").alias("pos"), F.col("doc").alias("by_doc"), F.col("pos").alias("by_pos"))
    turned = turned.groupBy("doc", "pos").agg(F.min(F.struct("by_doc", "by_pos")).alias("by")).select("doc", "pos", "by.by_doc", "by.by_pos")
    found = replaced.select("doc", "pos", "by_doc", "by_pos").union(longer).union(turned)
    return found.where("by_doc < doc or (by_doc = doc and by_pos < pos)").distinct()


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Places whose earlier neighbour is within one edit by its words."""
    by = lines.select(F.col("doc").alias("by_doc"), F.col("pos").alias("by_pos"), F.col("line").alias("by_line"))
    both = pairs.join(lines, ["doc", "pos"]).join(by, ["by_doc", "by_pos"]).select("doc", "pos", "line", "by_line")

    def run(batch: pa.RecordBatch):
        keep = [one_edit_apart(a.as_py().encode().split(), b.as_py().encode().split()) for a, b in zip(batch.column("line"), batch.column("by_line"))]
        yield batch.select(["doc", "pos"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, run, "doc long, pos int")


def removed_lines(docs: DataFrame, max_change: float = MAX_CHANGE, name: str = "lines") -> DataFrame:
    """(doc, pos) of lines that, in order of (doc_id, position), an earlier line equals or is one edit from, if one word is at most max_change of each."""
    near_words = max(1, math.ceil(1 / max_change))
    docs = text_of(docs)
    lines = written(_lines(docs, near_words), name)
    halves = [f"half{i}" for i in (1, 2, 3, 4)]
    first = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("at"), F.count("*").alias("n"), *(F.min(x).alias(x) for x in halves))
    first = written(first.select("h1", "h2", F.col("at.doc").alias("doc"), F.col("at.pos").alias("pos"), "n", *halves), f"{name}-first")
    again = written(first.where("n > 1").select("h1", "h2", F.col("doc").alias("by_doc"), F.col("pos").alias("by_pos")), f"{name}-again")
    copies = lines.select("doc", "pos", "h1", "h2").join(again, ["h1", "h2"]).where("doc <> by_doc or pos <> by_pos").select("doc", "pos")
    each = written(first.select("doc", "pos", F.explode(F.array(*halves)).alias("half")).where("half is not null"), f"{name}-halves")
    often = written(each.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), f"{name}-often")
    places = each.join(often, "half").select("doc", "pos").distinct()
    texts = written(_candidate_texts(docs, places), f"{name}-texts")
    for x in (first, each, often):
        dropped(x)
    found = written(_neighbours(texts, near_words, name), f"{name}-pairs")
    near = written(_verified(found, texts), f"{name}-near")
    out = written(copies.union(near).distinct(), f"{name}-gone")
    for x in (lines, again, texts, found, near):
        dropped(x)
    return out


def _cut(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with __gone (the positions of its lines to be removed, null if there are none), __lines, and __left, the text without them."""
    gone = gone.groupBy("doc").agg(F.collect_list("pos").alias("__gone")).withColumnRenamed("doc", "__doc")
    joined = docs.join(gone, known_id(docs) == gone["__doc"], "left").drop("__doc").withColumn("__lines", F.split("text", "\n", -1))
    # positions by a set operation, so that long texts take time in proportion
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    left = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    return joined.withColumn("__left", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left))


def without_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with all their columns and the text without the lines gone (doc, pos). Texts that lose lines and have no word left go."""
    rows = docs.select(F.struct("*").alias("__row"), "doc_id", "text")  # so that no column of docs clashes
    cut = _cut(rows, gone).where(F.col("__gone").isNull() | F.col("__left").rlike(WORD))
    return sized(cut.select(*((F.col("__left") if c == "text" else F.col("__row")[c]).alias(c) for c in docs.columns)))


def line_dedup(docs: DataFrame, max_change: float = MAX_CHANGE) -> DataFrame:
    """Removes lines that equal an earlier line, or are one word edit from it, in any document.

    Lines are \\n-split; earlier is by (doc_id, position); lines are judged on the input, so a line goes even if
    the earlier one goes too. Lines are compared by their words, and those without a word stay. A line near an earlier one goes if the
    word that an edit touches is at most max_change of either line's words. Returns doc_id, text (kept lines in order), n_lines,
    n_removed. A null text is one empty line; long texts and lines are compared whole. Rows that repeat a doc_id count as one document, and a null
    doc_id comes first. Other columns are ignored. An empty table gives an empty one.
    """
    docs = text_of(docs)
    cut = _cut(docs, removed_lines(docs, max_change))
    return sized(cut.select("doc_id", F.col("__left").alias("text"), F.size("__lines").cast("long").alias("n_lines"), F.size(F.coalesce("__gone", F.array().cast("array<int>"))).cast("long").alias("n_removed")))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
