"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's words. A randomised SVD finds the space of their strongest directions: each
task multiplies its passages with a random matrix and back, the products are added up over the cluster, and a
Nyström step on the driver gives right singular vectors and singular values from that one pass. Windows
of every document are compared with all benchmark passages by cosine in that space; a longest common
subsequence and the words of the answer decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.llm.frames import dropped, map_batches, text_of, written
from rowmill.llm.kernels import LOWER, SPACE, as_bytes, word_hashes, word_spans

#: Texts that are turned into arrays at a time, and blocks of them all together: a chunk ends at the first of both.
CHUNK, CHUNK_BLOCKS = 64, 2048
#: Words of a block; windows are two and four blocks.
BLOCK = 12
#: Benchmark passages that are searched, and so broadcast, at a time, and words of them all together: a block ends at the first of both.
QUERY_BLOCK, QUERY_WORDS = 2048, 65536
#: Queries that a word is counted for one by one in the filter of windows; a word of more queries counts as present for each.
HOLDERS = 64
#: Words of the longest piece of a passage that windows are compared with: those of the longest window.
PIECE = 4 * BLOCK

_TABLE = LOWER.copy()
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _TABLE[_c] = 0x20
assert SPACE[0x20]


def normal_words(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased, ASCII punctuation as spaces."""
    data = _TABLE[as_bytes(text)]
    return word_hashes(data, *word_spans(data))


@dataclass(frozen=True)
class Query:
    """A benchmark passage: its item, words, and the words of its answer (its last sentence)."""

    item_id: int
    words: tuple[int, ...]
    answer: tuple[int, ...]


def query_of(item_id: int, text: str | None) -> Query | None:
    """A whole passage, None if it has no word."""
    words = normal_words(text).tolist()
    if not words:
        return None
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text or "") if s.strip()]
    answer = normal_words(sentences[-1]).tolist() if sentences else []
    if len(answer) < 3:
        answer = words[-5:]
    return Query(item_id, tuple(words), tuple(answer))


class Vocabulary:
    """Column numbers of the words of the queries that tell them apart.

    Words of over 3 % of the queries (and of more than three) are left out, except in queries that would keep fewer than
    eight words.
    """

    def __init__(self, queries: list[Query]):
        counts = Counter(w for q in queries for w in set(q.words))
        most = max(3, len(queries) // 33)
        kept = {w for w, n in counts.items() if n <= most}
        for q in queries:
            if sum(w in kept for w in q.words) < 8:
                kept.update(q.words)
        self.words = np.unique(np.array(sorted(kept), dtype=np.uint64))
        self._seen = np.zeros(1 << 20, dtype=bool)
        self._seen[(self.words >> np.uint64(44)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.words)

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known words, and their columns."""
        at = np.flatnonzero(self._seen[(hashes >> np.uint64(44)).astype(np.int64)])
        column = np.minimum(np.searchsorted(self.words, hashes[at]), len(self.words) - 1)
        hit = self.words[column] == hashes[at]
        return at[hit], column[hit]


#: Bits of a column number in a packed (block, column).
_BITS = 20


def with_known(rows: DataFrame, vocabulary) -> DataFrame:
    """rows (row, items) with known (block and column of each known word of the text, packed) and blocks (blocks of the text)."""

    def run(batch: pa.RecordBatch):
        packed, sizes = [], []
        for text in batch.column("row").field("text"):
            h = normal_words(text.as_py())
            at, column = vocabulary.value.known(h)
            packed.append(at // BLOCK << _BITS | column)
            sizes.append(-(-len(h) // BLOCK))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in packed])]).astype(np.int32)
        known = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(packed), pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, known, pa.array(sizes, pa.int32())], names=[*batch.schema.names, "known", "blocks"])

    fields = [*rows.schema.fields, T.StructField("known", T.ArrayType(T.LongType())), T.StructField("blocks", T.IntegerType())]
    return map_batches(rows, run, T.StructType(fields))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """A chunk of rows at a time: the first row, blocks and columns of known words, and the first block of each row and the number of all."""
    known = batch.column("known")
    offsets, values, sizes = np.asarray(known.offsets), np.asarray(known.values), np.asarray(batch.column("blocks"))
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    i = 0
    while i < len(batch):
        end = max(i + 1, min(i + CHUNK, int(np.searchsorted(total, total[i] + CHUNK_BLOCKS, side="right")) - 1))
        cuts = offsets[i : end + 1]
        packed = values[cuts[0] : cuts[-1]]
        firsts = total[i : end + 1] - total[i]
        yield i, (packed >> _BITS) + np.repeat(firsts[:-1], np.diff(cuts)), packed & ((1 << _BITS) - 1), firsts
        i = end


def _sum_blocks(values: np.ndarray, blocks: np.ndarray, total: int) -> np.ndarray:
    """Rows summed by their (ascending) block."""
    out = np.zeros((total, values.shape[1]), dtype=values.dtype)
    if len(blocks):
        cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
        out[blocks[cuts]] = np.add.reduceat(values, cuts, axis=0)
    return out


def _sketch(blocks: np.ndarray, columns: np.ndarray, firsts: np.ndarray, omega: np.ndarray, out: np.ndarray) -> None:
    """Adds the passages' (frequency' * frequency * omega | passages with the word) to out; a passage is four blocks."""
    if not len(blocks):
        return
    first_of = firsts[np.searchsorted(firsts, blocks, side="right") - 1]
    passage = first_of + (blocks - first_of) // 4
    projected = _sum_blocks(omega[columns], passage, int(firsts[-1]))
    order = np.argsort(columns, kind="stable")
    cuts = np.flatnonzero(np.diff(columns[order], prepend=-1))
    out[columns[order][cuts], :-1] += np.add.reduceat(projected[passage[order]], cuts, axis=0)
    once = np.unique(passage * len(out) + columns) % len(out)
    out[:, -1] += np.bincount(once, minlength=len(out))


def _gathered(known: DataFrame, n_words: int, omega) -> np.ndarray:
    """The sketch of all documents: a row for each word of the vocabulary (bounded by QUERY_WORDS); tasks send the slices that they have words of."""
    rows = 256

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = omega.value
        out = np.zeros((n_words, o.shape[1] + 1))
        for batch in batches:
            for _, blocks, columns, firsts in _chunks(batch):
                _sketch(blocks, columns, firsts, o, out)
        slices = [i for i in range(-(-n_words // rows)) if out[i * rows : (i + 1) * rows].any()]
        parts = [out[i * rows : (i + 1) * rows].tobytes() for i in slices]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([part] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "part", "data"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in group["data"]], axis=0)
        return pd.DataFrame({"slice": [int(group["slice"].iloc[0])], "part": [int(group["part"].iloc[0])], "data": [total.tobytes()]})

    schema = "slice int, part int, data binary"
    parts = known.select("known", "blocks").mapInArrow(add_up, schema)
    for width in (4096, 64, 1):  # so that no task adds up more than a few dozen slices
        parts = parts.withColumn("part", F.col("part") % width).groupBy("slice", "part").applyInPandas(add, schema)
    total = np.zeros((n_words, omega.value.shape[1] + 1))
    for r in parts.collect():
        total[r["slice"] * rows : (r["slice"] + 1) * rows] = np.frombuffer(r["data"]).reshape(-1, total.shape[1])
    return total


class Holders:
    """The queries that have a word, for an upper bound of a query's words in a stretch of text."""

    def __init__(self, columns: list[frozenset[int]], n_words: int):
        self.sizes = np.array([len(c) for c in columns])
        column = np.array([x for c in columns for x in c], dtype=np.int64)
        query = np.repeat(np.arange(len(columns)), self.sizes)
        listed = np.bincount(column, minlength=n_words)[column] <= HOLDERS
        self.common = np.bincount(query[~listed], minlength=len(columns))
        column, query = column[listed], query[listed]
        self.queries = query[np.argsort(column, kind="stable")]
        self.counts = np.bincount(column, minlength=n_words)
        self.firsts = np.cumsum(self.counts) - self.counts

    def most(self, blocks: np.ndarray, columns: np.ndarray, which: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For queries `which` the words that can stand in the blocks from start to end: no fewer than their distinct ones there.

        blocks (ascending) and columns: the known words of a stretch that has all of these blocks.
        """
        wanted = np.zeros(len(self.sizes), dtype=bool)
        wanted[which] = True
        counts = self.counts[columns]
        at = np.repeat(self.firsts[columns] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        query, block = self.queries[at], np.repeat(blocks, counts)
        width = int(end.max()) + 1
        inside = wanted[query] & (block < width)
        keys = np.sort(query[inside] * width + block[inside])
        return self.common[which] + np.searchsorted(keys, which * width + end) - np.searchsorted(keys, which * width + start)


@dataclass(frozen=True)
class Space:
    """Latent vectors of words, the normalised latent vectors of the queries' pieces, the query of each piece, and what the search needs of each query."""

    latent: np.ndarray
    targets: np.ndarray
    of: np.ndarray
    queries: list[Query]
    lengths: np.ndarray
    columns: list[frozenset[int]]
    holders: Holders


def pieces(words: tuple[int, ...]) -> list[tuple[int, ...]]:
    """A passage's words in the fewest parts of about equal length that a window can hold. If a text holds a share of the
    passage's words in order, it holds that share of one of the parts' at least."""
    n = -(-len(words) // PIECE)
    cuts = [len(words) * i // n for i in range(n + 1)]
    return [words[a:b] for a, b in zip(cuts, cuts[1:])]


def fit(known: DataFrame, vocabulary: Vocabulary, queries: list[Query], rank: int) -> Space:
    """The latent space of all documents' passages (rows with known) and the queries'."""
    omega = np.random.default_rng(7).standard_normal((len(vocabulary), rank)).astype(np.float32)
    shared = known.sparkSession.sparkContext.broadcast(omega)
    total = _gathered(known, len(vocabulary), shared)
    shared.unpersist()
    return space_of(total, omega, vocabulary, queries)


def space_of(total: np.ndarray, omega: np.ndarray, vocabulary: Vocabulary, queries: list[Query]) -> Space:
    """The latent space from the documents' sketch."""
    for q in queries:  # the benchmark's passages are rows too
        column = vocabulary.known(np.array(q.words, dtype=np.uint64))[1]
        total[:, :-1] += np.bincount(column, minlength=len(vocabulary))[:, None] * omega[column].sum(axis=0)
    with_word = total[:, -1]
    idf = np.log(1 + (with_word.max() + 1) / (with_word + 1))
    # frequencies F, weights D = diag(idf): products (F D)'(F D) (D^-1 omega) = D * F'F omega
    y = idf[:, None] * total[:, :-1]
    middle = omega.T.astype(float) @ total[:, :-1]
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    strong = values > values.max() * 1e-9
    right, singular, _ = np.linalg.svd(y @ (vectors[:, strong] / np.sqrt(values[strong])), full_matrices=False)
    # partly whitened by the singular values, so that the commonest words don't outweigh the rest
    latent = (idf[:, None] * right / np.maximum(singular, singular.max() * 1e-6) ** 0.5).astype(np.float32)
    latent /= np.abs(latent).max() + 1e-30
    columns = [vocabulary.known(np.array(q.words, dtype=np.uint64))[1] for q in queries]
    parts = [(i, vocabulary.known(np.array(part, dtype=np.uint64))[1]) for i, q in enumerate(queries) for part in pieces(q.words)]
    targets = np.stack([latent[c].sum(axis=0) for _, c in parts])
    targets /= np.linalg.norm(targets, axis=1, keepdims=True) + 1e-30
    distinct = [frozenset(c.tolist()) for c in columns]
    return Space(latent, targets, np.array([i for i, _ in parts]), queries, np.array([len(q.words) for q in queries]), distinct, Holders(distinct, len(vocabulary)))


def common_length(a: tuple[int, ...], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & masks.get(w, 0)
        if m:
            row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def search(blocks: np.ndarray, columns: np.ndarray, firsts: np.ndarray, text_of: Callable[[int], str | None], space: Space, least_cosine: float, least_common: float, least_answer: float) -> list[list[int]]:
    """The items that each text of a chunk holds."""
    found: list[set[int]] = [set() for _ in firsts[1:]]
    total = int(firsts[-1])
    if not len(blocks):
        return [[] for _ in found]
    words: dict[int, np.ndarray] = {}
    two = _sum_blocks(space.latent[columns], blocks, total)
    owner = np.repeat(np.arange(len(found)), np.diff(firsts))
    last = firsts[1:][owner]
    at = np.arange(total)
    # windows of two blocks at every block, and of four at every second one, none reaching into the next text
    inside = at[at + 1 < last]
    two[inside] += two[inside + 1]  # the right side is copied before it changes
    even = at[(at - firsts[:-1][owner]) % 2 == 0]
    four = two[even]
    inside = np.flatnonzero(even + 2 < last[even])
    four[inside] += two[even[inside] + 2]
    vectors = np.concatenate([two, four])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-30
    starts = np.concatenate([at, even])
    ends = np.minimum(starts + np.repeat([2, 4], [total, len(even)]), last[starts])
    for i in range(0, len(starts), 4096):
        cosines = vectors[i : i + 4096] @ space.targets.T
        near = np.flatnonzero(cosines.max(axis=1) >= least_cosine)
        row, which = np.nonzero(cosines[near] >= least_cosine)
        if not len(row):
            continue
        window, which = near[row] + i, space.of[which]
        s, e = starts[window], ends[window]
        doc = owner[s]
        # known words that stand within a passage's length of the window: the passage's own can't be more
        pad = space.lengths[which] // BLOCK + 1
        from_block, to_block = np.maximum(firsts[doc], s - pad), np.minimum(firsts[doc + 1], e + pad)
        low, high = np.searchsorted(blocks, from_block), np.searchsorted(blocks, to_block)
        stretch = slice(int(low.min()), int(high.max()))
        most = space.holders.most(blocks[stretch], columns[stretch], which, from_block, to_block)
        able = np.flatnonzero(most + space.lengths[which] - space.holders.sizes[which] >= least_common * space.lengths[which])
        s, doc, which, low, high = s[able], doc[able], which[able], low[able].tolist(), high[able].tolist()
        seen: tuple[tuple[int, int] | None, set[int]] = (None, set())
        looked: set[tuple[int, int, int]] = set()
        for k, q in enumerate(which.tolist()):
            if seen[0] != (low[k], high[k]):
                seen = ((low[k], high[k]), set(columns[low[k] : high[k]].tolist()))
            query, mine = space.queries[q], space.columns[q]
            n = len(query.words)
            if len(mine & seen[1]) + n - len(mine) < least_common * n or query.item_id in found[doc[k]]:
                continue
            d = int(doc[k])
            if d not in words:
                words[d] = normal_words(text_of(d))
            # windows near each other share one look, a quarter of a passage's length wide
            step = max(1, n // 4 // BLOCK)
            place = int(s[k] - firsts[d]) // step
            if (d, q, place) in looked:
                continue
            looked.add((d, q, place))
            part = words[d][max(0, place * step * BLOCK - n) : (place * step + step - 1 + 4) * BLOCK + n].tolist()
            if common_length(query.words, part) >= least_common * n and common_length(query.answer, part) >= least_answer * len(query.answer):
                found[d].add(query.item_id)
    return [sorted(x) for x in found]


def with_items(docs: DataFrame, benchmark: DataFrame, column: str = "items", least_cosine: float = 0.4, least_common: float = 0.6, least_answer: float = 0.5, rank: int = 96) -> DataFrame:
    """docs with an array of the item_ids of the benchmark passages that the text holds, whole or paraphrased.

    A passage, of any length, is held if least_common of its words stand in the same order near a window whose latent cosine
    with a piece of it (at most PIECE words) is least_cosine or more, and so does least_answer of its answer. Null texts, and items without words or an id, hold and
    match nothing. The benchmark is searched in blocks of QUERY_BLOCK passages, or QUERY_WORDS words, so what is broadcast is bounded; for each
    the documents are written with the numbers of their known words, from which both passes read. Repeated rows are judged
    each; very long texts are searched whole; all columns of docs stay.
    """
    context = docs.sparkSession.sparkContext
    out = docs.select(F.struct("*").alias("row"), F.array().cast("array<bigint>").alias("items"))  # so that no column of docs clashes
    tables: list[DataFrame] = []

    def add(frame: DataFrame, block: list[Query]) -> DataFrame:
        vocabulary = Vocabulary(block)
        known = written(with_known(frame, context.broadcast(vocabulary)), "known-words")
        for table in tables:  # that of the block before has been read
            dropped(table)
        tables[:] = [known]
        space = context.broadcast(fit(known, vocabulary, block, rank))

        def run(batch: pa.RecordBatch):
            texts, items = batch.column("row").field("text"), []
            for i, blocks, columns, firsts in _chunks(batch):
                items += search(blocks, columns, firsts, lambda k, i=i: texts[i + k].as_py(), space.value, least_cosine, least_common, least_answer)
            both = [sorted({*(a or ()), *b}) for a, b in zip(batch.column("items").to_pylist(), items)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(both, pa.list_(pa.int64()))], names=["row", "items"])

        return map_batches(known, run, frame.schema)

    block: list[Query] = []
    n_words = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").toLocalIterator():
        query = query_of(row["item_id"], row["text"])
        if query is not None:
            block.append(query)
            n_words += len(query.words)
        if len(block) >= QUERY_BLOCK or n_words >= QUERY_WORDS:
            out, block, n_words = add(out, block), [], 0
    if block:
        out = add(out, block)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != column), F.col("items").alias(column))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """doc_id, items (ids of the benchmark passages held), contaminated. An empty table gives an empty one."""
    rows = text_of(docs)
    return with_items(rows, benchmark, **parameters).select("doc_id", F.array_sort("items").alias("items"), (F.size("items") > 0).alias("contaminated"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "contaminated")
