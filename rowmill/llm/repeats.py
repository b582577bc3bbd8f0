"""Winnowed anchors as tables: the seeding shared by the two operators that remove repeated passages.

Every window of a document belongs to one anchor occurrence (kernels.owned_windows), so equal windows
meet under equal anchors and nothing is lost by looking at anchors alone. Occurrences leave a task
already grouped by context, hence a third of all rows being copies adds one row for each task, not
one for each copy. A null doc_id stands as NULL_ID.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.frames import dropped, map_batches, written
from rowmill.llm.kernels import as_bytes, covered, owned_windows, signed

NULL_ID = -(2**63)
#: One row for each context in a batch of documents, with its places: document, first window, windows, anchor's place.
GROUPS = "anchor long, context long, least_doc long, n long, docs array<long>, firsts array<int>, counts array<int>, places array<int>"
#: From occurrences (anchor, context, doc, first, count, place) to an order that puts equal contexts side by side, and the cuts between them.
Grouping = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("doc_id").fill_null(NULL_ID))


def by_sorting(anchor: np.ndarray, context: np.ndarray, doc_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups by a plain sort on (anchor, context)."""
    order = np.lexsort((context, anchor))
    a, c = anchor[order], context[order]
    cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), dtype=bool), (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
    return order, cuts


def anchor_groups(docs: DataFrame, units, window: int, k: int, grouping: Grouping) -> DataFrame:
    """Documents (doc_id, text) to rows of GROUPS."""

    def lists(values, offsets, kind):
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind)))

    def run(batch: pa.RecordBatch):
        found = []
        for doc, text in zip(ids_of(batch), batch.column("text")):
            a, c, f, n, p = owned_windows(units(as_bytes(text.as_py())), window, k)
            if len(a):
                found.append((a, c, np.full(len(a), doc, dtype=np.int64), f, n, p))
        if not found:
            return
        anchor, context, doc, first, count, place = (np.concatenate(x) for x in zip(*found))
        order, cuts = grouping(anchor, context, np.cumsum([len(x[0]) for x in found]))
        anchor, context, doc, first, count, place = (x[order] for x in (anchor, context, doc, first, count, place))
        offsets = np.append(cuts, len(order))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(anchor[cuts])), pa.array(signed(context[cuts])), pa.array(np.minimum.reduceat(doc, cuts)), pa.array(np.diff(offsets).astype(np.int64)),
                lists(doc, offsets, np.int64), lists(first, offsets, np.int32), lists(count, offsets, np.int32), lists(place, offsets, np.int32),
            ],
            names=["anchor", "context", "least_doc", "n", "docs", "firsts", "counts", "places"],
        )

    return map_batches(docs, run, GROUPS)


def seed(docs: DataFrame, units, window: int, k: int, grouping: Grouping, name: str) -> DataFrame:
    """Occurrences of anchors that stand in two places at least, as a written table: doc_id, first, count, place,
    least (the least document with the same context), n (places with the same context), several (whether
    the anchor has other contexts too), anchor."""
    groups = written(anchor_groups(docs, units, window, k, grouping), f"{name}-groups")
    anchors = written(
        groups.groupBy("anchor").agg(F.sum("n").alias("places_of"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("places_of > 1").select("anchor", F.expr("lo <> hi").alias("several")),
        f"{name}-anchors",
    )
    live = written(groups.join(anchors, "anchor"), f"{name}-live")
    dropped(groups)
    dropped(anchors)
    contexts = written(live.groupBy("anchor", "context").agg(F.min("least_doc").alias("least"), F.sum("n").alias("places_of")), f"{name}-contexts")
    places = F.arrays_zip("docs", "firsts", "counts", "places")
    joined = live.drop("least_doc", "n").join(contexts, ["anchor", "context"]).select("anchor", "least", F.col("places_of").alias("n"), "several", F.explode(places).alias("at"))
    out = written(
        joined.select(F.col("at.docs").alias("doc_id"), F.col("at.firsts").alias("first"), F.col("at.counts").alias("count"), F.col("at.places").alias("place"), "least", "n", "several", "anchor")
        .where("n > 1 or several"),
        f"{name}-occurrences",
    )
    dropped(live)
    dropped(contexts)
    return out


def spans_of(rows: DataFrame, *more: str) -> DataFrame:
    """(doc_id, first, count) rows to one row for each document with its arrays, in no set order."""
    names = ("first", "count", *more)
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("spans")).select(F.col("doc_id").alias("span_doc"), *(F.col(f"spans.{x}").alias(f"{x}s") for x in names))


def known_id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"], F.lit(NULL_ID))


def removed_units(firsts, counts, window: int, n: int) -> np.ndarray:
    """Which of n units the windows of a document's spans cover."""
    if not firsts.is_valid:
        return np.zeros(n, dtype=bool)
    first, count = (np.asarray(x.values, dtype=np.int64) for x in (firsts, counts))
    return covered(first, count, window, n)
