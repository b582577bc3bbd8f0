"""Substring dedup by seed and extend, over words: documents are joined on winnowed anchors, and matches extended both ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.frames import map_batches, sized, text_of, written
from rowmill.llm.kernels import RunHasher, as_bytes, mix, signed, word_hashes, word_spans
from rowmill.llm.repeats import by_sorting, ids_of, known_id, removed_units, seed, spans_of

#: Bytes of word hashes that are resolved together, on average, and contexts of an anchor that go into one bucket at most.
BUCKET_BYTES, MAX_CONTEXTS = 4 << 20, 256


def word_units(data: np.ndarray) -> np.ndarray:
    return word_hashes(data, *word_spans(data))


def extended(words: list[np.ndarray], places: np.ndarray, docs: np.ndarray, counts: np.ndarray, window: int) -> list[np.ndarray]:
    """Which of the first `counts` windows of each context stand in one of a smaller document; contexts share the anchor at their places.

    The match of two contexts is extended from the anchor to both sides as far as their words are equal: a maximal repeat. If
    it has `window` words or more, all windows inside repeat.
    """
    order = np.argsort(docs, kind="stable")
    left, right = int(places.max()), max(len(w) - p for w, p in zip(words, places.tolist()))
    # words before the anchor from right to left, and those from it on; what lies outside of a context equals nothing
    outside = mix(np.arange(len(words), dtype=np.uint64) + np.uint64(1)).astype(np.int64)[:, None]
    before, behind = np.repeat(outside, left, axis=1), np.repeat(outside, right, axis=1)
    for row, i in enumerate(order.tolist()):
        p = int(places[i])
        before[row, :p] = words[i][:p][::-1]
        behind[row, : len(words[i]) - p] = words[i][p:]
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(words)
    for row, i in enumerate(order.tolist()):
        n, p = int(counts[i]), int(places[i])
        smaller = int(np.searchsorted(docs[order], docs[i]))
        steps = np.zeros(n + 1, dtype=np.int64)
        if smaller:
            a, b = before[:smaller] != before[row], behind[:smaller] != behind[row]
            reach_a = np.where(a.any(axis=1), a.argmax(axis=1), left) if left else np.zeros(smaller, dtype=np.int64)
            reach_b = np.where(b.any(axis=1), b.argmax(axis=1), right)
            long = reach_a + reach_b >= window
            first = np.maximum(p - reach_a[long], 0)
            last = np.minimum(p + reach_b[long] - window, n - 1)
            kept = first <= last
            np.add.at(steps, first[kept], 1)
            np.add.at(steps, last[kept] + 1, -1)
        out[i] = np.cumsum(steps[:n]) > 0
    return out


def _by_extension(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """Runs (doc_id, first, count) of the windows of places (anchor, doc_id, first, count, place) that one of a smaller document repeats:
    documents are joined on their anchors, by dealing the contexts of an anchor into one bucket of some BUCKET_BYTES."""

    def contexts(batch: pa.RecordBatch):
        for doc, text, *runs in zip(ids_of(batch), *(batch.column(x) for x in ("text", "firsts", "counts", "places", "anchors"))):
            units = signed(word_units(as_bytes(text.as_py())))
            first, count, place, anchor = (np.asarray(x.values, dtype=np.int64) for x in runs)
            inside = first + count - 1 + window <= len(units)  # else of another row with the same doc_id
            first, count, place, anchor = (x[inside] for x in (first, count, place, anchor))
            if not len(first):
                continue
            parts = [units[f : f + n - 1 + window] for f, n in zip(first.tolist(), count.tolist())]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(np.full(len(first), doc)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))],
                names=["anchor", "doc_id", "first", "count", "place", "words"],
            )

    def resolve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        anchor, doc, first, count, place = (np.asarray(table.column(x)) for x in ("anchor", "doc_id", "first", "count", "place"))
        lists = table.column("words").chunk(0) if table.num_rows else None
        offsets, values = (np.asarray(lists.offsets), np.asarray(lists.values)) if table.num_rows else (None, None)
        order = np.argsort(anchor, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(anchor[order])) + 1) if len(order) else []
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for group in groups:
            found = extended([values[offsets[i] : offsets[i + 1]] for i in group.tolist()], place[group].astype(np.int64), doc[group], count[group], window)
            for i, late in zip(group.tolist(), found):
                if late.any():
                    edges = np.flatnonzero(np.diff(late.astype(np.int8), prepend=0, append=0))
                    rows.append((np.full(len(edges) // 2, doc[i]), first[i] + edges[::2], edges[1::2] - edges[::2]))
        docs_of, firsts, lengths = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, dtype=np.int64),) * 3
        return pa.table({"doc_id": docs_of, "first": firsts.astype(np.int32), "count": lengths.astype(np.int32)})

    size = places.agg(F.coalesce(F.sum(F.col("count") + (window - 1)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-8 * size // BUCKET_BYTES))
    runs = spans_of(places, "place", "anchor")
    texts = docs.join(runs, known_id(docs) == runs["span_doc"]).select("doc_id", "text", "firsts", "counts", "places", "anchors")
    dealt = map_batches(texts, contexts, "anchor long, doc_id long, first int, count int, place int, words array<long>").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(resolve, "doc_id long, first int, count int")


def _by_windows(docs: DataFrame, places: DataFrame, window: int, name: str) -> DataFrame:
    """The same by aggregates of all windows, so that no group of any key is gathered."""
    open_runs = spans_of(places)

    def windows(batch: pa.RecordBatch):
        found = []
        for doc, text, firsts, counts in zip(ids_of(batch), *(batch.column(x) for x in ("text", "firsts", "counts"))):
            units = word_units(as_bytes(text.as_py()))
            first, count = (np.asarray(x.values, dtype=np.int64) for x in (firsts, counts))
            starts = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            starts = np.unique(starts[starts + window <= len(units)])
            found.append((signed(RunHasher(units).runs(starts, starts + window)), np.full(len(starts), doc), starts.astype(np.int32)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["hash", "doc_id", "first"])

    texts = docs.join(open_runs, known_id(docs) == open_runs["span_doc"]).select("doc_id", "text", "firsts", "counts")
    single = written(map_batches(texts, windows, "hash long, doc_id long, first int"), f"{name}-windows")
    least = written(single.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("hash", "least"), f"{name}-least")
    late = single.join(least, "hash").where("doc_id > least").select("doc_id", "first", F.lit(1).alias("count"))
    return late


def repeated_spans(docs: DataFrame, window: int = 50, k: int = 10, name: str = "substring") -> DataFrame:
    """Runs of windows (doc_id, first, count), in words, that also start in a document with a smaller doc_id.

    Seed: anchors winnowed from every window. An anchor's context reaches as far as its windows; contexts that are
    equal as a whole need no look. Of the others, one document (the least) for each context is joined with
    those of the same anchor, and their matches are extended both ways. Anchors with very many contexts don't go into one
    task: their windows meet in aggregates. The runs of a document, put together, are its maximal repeats of `window` words or more.
    """
    docs = text_of(docs)
    places = seed(docs, word_units, window, k, by_sorting, name)
    whole = places.where("doc_id > least").select("doc_id", "first", "count")
    alone = places.where("several and doc_id = least").select("anchor", "doc_id", "first", "count", "place")
    alone = written(alone.join(alone.groupBy("anchor").agg(F.count("*").alias("contexts")), "anchor"), f"{name}-open")
    out = whole.union(written(_by_extension(docs, alone.where(F.col("contexts") <= MAX_CONTEXTS), window), f"{name}-repeats"))
    common = alone.where(F.col("contexts") > MAX_CONTEXTS)
    if common.limit(1).count():
        out = out.union(_by_windows(docs, common, window, name))
    return out


def substring_dedup(docs: DataFrame, window: int = 50, k: int = 10) -> DataFrame:
    """Removes from each text the words of passages of `window` words or more that a document with a smaller id has too.

    Returns doc_id, text (the kept words, joined by one space), n_words, n_removed. A null or empty text has no words;
    a text of fewer words than `window` stays whole. Rows that repeat a doc_id count as one
    document: what is found in one is removed, by place, from each. A null doc_id counts as the
    smallest. Other columns of docs are ignored. An empty table gives an empty one.
    """
    docs = text_of(docs)
    spans = spans_of(repeated_spans(docs, window, k))
    texts = sized(docs.join(spans, known_id(docs) == spans["span_doc"], "left").select("doc_id", "text", "firsts", "counts"))

    def cut(batch: pa.RecordBatch):
        kept_texts, n_words, n_removed = [], [], []
        for text, firsts, counts in zip(*(batch.column(x) for x in ("text", "firsts", "counts"))):
            data = as_bytes(text.as_py())
            starts, ends = word_spans(data)
            gone = removed_units(firsts, counts, window, len(starts))
            words = data.tobytes().split()  # at the same six bytes
            kept_texts.append(b" ".join(w for w, x in zip(words, gone) if not x).decode("utf-8") if gone.any() else b" ".join(words).decode("utf-8"))
            n_words.append(len(starts))
            n_removed.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept_texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return map_batches(texts, cut, "doc_id long, text string, n_words long, n_removed long")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
