"""Suffix-array dedup over bytes, by Lyndon-grouped suffix arrays that shuffles put together.

Windows of text are dealt to tasks by their winnowed anchor, so equal windows meet in one bucket of bounded
size. There the strings around the anchors are parsed into short content-defined phrases, and the suffix array of that parse is built by
Lyndon grouping. Each phrase stands for a fixed number of bytes and tells where the next one begins, so the array is in the
order of the bytes from each phrase on. The longest common prefixes of its neighbours then say
which places begin with the same bytes, and so which windows stand in two places. A suffix array of all bytes instead of
the parse would cost a task some ten microseconds a byte in Python. Anchors with very many contexts don't go into one task: their windows
meet in aggregates, by blocks and then one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.frames import dropped, map_batches, sized, text_of, written
from rowmill.llm.kernels import BYTE_VALUES, RunHasher, as_bytes, mix, signed, sliding_min
from rowmill.llm.repeats import by_sorting, ids_of, removed_units, seed, spans_of

#: Windows of one block share all bytes but this many at either end.
FRINGE = 15
#: Bytes of strings that make one suffix array, on average.
BUCKET_BYTES = 2 << 20
#: Contexts of an anchor that go into one bucket at most; those of other anchors meet in aggregates.
MAX_CONTEXTS = 1024


def byte_units(data: np.ndarray) -> np.ndarray:
    return BYTE_VALUES[data]


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """Suffixes grouped by their longest Lyndon prefix, and their previous-smaller pointers.

    Returns for each suffix the first slot of its group, groups in lexicographic order, and the nearest
    suffix to its left that is smaller (-1: none). Groups are visited in descending order. All suffixes
    to the left of a visited one that are still in the list are smaller, so the pointer is the
    neighbour in a linked list from which visited suffixes are taken. The Lyndon prefix of a parent
    is its symbol followed by those of its children in descending order: a visited group moves its
    parents to the high end of their own groups, by the number of children they have in it.
    """
    n = len(text)
    slots = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n  # of a suffix
    low: list[int] = []  # first slot of a group
    high: list[int] = []  # end of what is not split off yet
    last = None
    for slot, i in enumerate(slots):
        if text[i] != last:
            last = text[i]
            low.append(slot)
            high.append(slot)
        place[i] = slot
        group[i] = len(low) - 1
        high[-1] = slot + 1
    before = list(range(-1, n - 1))
    after = list(range(1, n + 1))
    top = n
    while top:
        current = group[slots[top - 1]]
        bottom = low[current]
        members = slots[bottom:top]
        if len(members) > 1:
            members.sort()
        parents: dict[int, int] = {}
        for i in members:  # from left to right, so that no pointer leads to a member
            left, right = before[i], after[i]
            if left >= 0:
                after[left] = right
                parents[left] = parents.get(left, 0) + 1
            if right < n:
                before[right] = left
        ordered = parents.items() if len(parents) < 2 else sorted(parents.items(), key=lambda x: -x[1])
        fresh: dict[int, tuple[int, int]] = {}  # a group to its newest part: children, number
        for i, children in ordered:
            old = group[i]
            part = fresh.get(old)
            end = high[old] - 1
            high[old] = end
            if part is None or part[0] != children:
                low.append(end)
                high.append(end + 1)
                part = fresh[old] = (children, len(low) - 1)
            else:
                low[part[1]] = end
            other, at = slots[end], place[i]
            slots[at], slots[end] = other, i
            place[other], place[i] = at, end
            group[i] = part[1]
        top = bottom
    return [low[g] for g in group], before


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in lexicographic order, by linear grouping without renaming.

    Within a group, suffixes follow the order of the suffixes behind their Lyndon prefixes. So
    the array is filled from the left: each suffix emits those whose Lyndon prefix ends at it, which are the
    pointer chain from its left neighbour down to the first that is placed already.
    """
    slot_of, pointer = lyndon_groups(text)
    n = len(text)
    free = list(range(n))  # next free slot, by a group's first slot
    out = [-1] * n
    placed = bytearray(n)
    i = n - 1
    at = 0
    while True:
        while i >= 0 and not placed[i]:
            g = slot_of[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = 1
            i = pointer[i]
        if at == n:
            return out
        i = out[at] - 1
        at += 1


def _parse(hasher: RunHasher, begins: np.ndarray, ends: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of strings that stand one behind another, by winnowing: the owner of each place (the least k-gram of the next
    `width`, the leftmost of equal ones), starts of the phrases, the string of each, and whether its symbol stands twice.

    A phrase's symbol is the width + k bytes from its start, which settle where the next phrase starts; one that reaches the
    end of its string is the string's last.
    """
    low = np.uint64(0xFFFFFFFF)
    grams = hasher.grams(k)
    owner = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width) & low).astype(np.int64)
    last = ends - width - k + 1  # of the places with an owner in their string
    lengths = np.maximum(last + 1 - begins, 0)
    at = np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    of = np.repeat(np.arange(len(begins)), lengths)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (of[1:] != of[:-1])
    starts, of = owner[at[new]], of[new]
    cut = starts + width + k > ends[of]
    first_cut = cut.copy()
    first_cut[1:] &= ~(cut[:-1] & (of[1:] == of[:-1]))
    starts, of = starts[~cut | first_cut], of[~cut | first_cut]
    _, number, n_of = np.unique(hasher.runs(starts, np.minimum(starts + width + k, ends[of])), return_inverse=True, return_counts=True)
    return owner, starts, of, n_of[number] > 1


def _ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Ranks, from 1, of the `length` bytes from each start; past the end of a string stands 0xFF, which UTF-8 lacks."""
    text = np.empty((len(starts), length), dtype=np.uint8)
    for i in range(length):
        place = starts + i
        text[:, i] = np.where(place < ends, data[np.minimum(place, len(data) - 1)], 0xFF)
    return np.unique(text.view(f"S{length}").reshape(-1), return_inverse=True)[1].reshape(-1) + 1


def _common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the texts from a and from b have in common, up to `most`; rest_a and rest_b: bytes to the ends of their strings."""
    out = np.minimum(np.minimum(rest_a, rest_b), most)
    # the eight bytes from every place as one number, so that a comparison takes eight bytes at once
    padded = np.concatenate([data, np.zeros(most + 16, dtype=np.uint8)])
    words = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    reach = np.arange(0, most, 8)
    for i in range(0, len(a), 4096):
        differ = words[a[i : i + 4096, None] + reach] ^ words[b[i : i + 4096, None] + reach]
        at = (differ != 0).argmax(axis=1)
        word = differ[np.arange(len(at)), at]
        equal = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)) // 8  # of its bytes, from the first
        first = np.where(word != 0, 8 * at + equal, most)
        out[i : i + 4096] = np.minimum(out[i : i + 4096], first)
    return out


def repeated_windows(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, counts: np.ndarray, window: int, array_of=suffix_array) -> np.ndarray:
    """Starts in data, ascending, of the windows that stand in two places at least.

    data holds strings from begins to ends; the windows of a string are the `counts` first ones. A window belongs to the phrase
    that owns its start, j bytes behind it. Two windows are equal if they have equal j, equal j bytes before their phrases, and
    suffixes from there with a common prefix of window - j bytes: an interval of the suffix array in which no two neighbours
    have a shorter one.
    """
    width, k = window // 4, max(1, min(16, window // 10))
    hasher = RunHasher(BYTE_VALUES[data])
    owner, starts, of, twice = _parse(hasher, begins, ends, width, k)
    none = np.zeros(0, dtype=np.int64)
    # what follows a symbol that stands once decides nothing
    kept = twice.copy()
    kept[1:] |= twice[:-1] & (of[1:] == of[:-1])
    kept = np.flatnonzero(kept)
    if not len(kept):
        return none
    symbols = np.zeros(len(starts), dtype=np.int64)
    symbols[kept] = _ranks(data, starts[kept], ends[of[kept]], width + k)
    # one end symbol behind each string, higher than all others
    behind = np.flatnonzero(np.diff(of[kept], append=-1)) + 1
    text = np.insert(symbols[kept], behind, symbols.max() + 1)
    phrase_of = np.insert(kept, behind, -1)
    order = phrase_of[np.asarray(array_of(text.tolist()), dtype=np.int64)]
    order = order[order >= 0]
    order = order[twice[order]]
    common = np.zeros(len(order), dtype=np.int64)  # with the neighbour before
    near = np.flatnonzero(symbols[order[1:]] == symbols[order[:-1]]) + 1
    a, b = order[near - 1], order[near]
    common[near] = _common_prefixes(data, starts[a], starts[b], ends[of[a]] - starts[a], ends[of[b]] - starts[b], window)
    rank = np.full(len(starts), -1, dtype=np.int64)
    rank[order] = np.arange(len(order))
    at = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    phrase = np.full(len(data), -1, dtype=np.int64)
    # of equal starts in several phrases there are none: a place has one owner
    phrase[starts] = np.arange(len(starts))
    r = rank[phrase[owner[at]]]
    j = owner[at] - at
    best = np.maximum(common, np.append(common[1:], 0))
    live = (r >= 0) & (best[r] >= window - j)
    at, r, j = at[live], r[live], j[live]
    by_j = np.argsort(j, kind="stable")
    at, r, j = at[by_j], r[by_j], j[by_j]
    interval = np.empty(len(at), dtype=np.uint64)
    for n in np.unique(j).tolist():
        low, high = np.searchsorted(j, [n, n + 1])
        interval[low:high] = np.cumsum(common < window - n)[r[low:high]]
    left = hasher.runs(at, at + j)
    keys = mix(left + interval * np.uint64(0x9E3779B97F4A7C15)) ^ mix(j.astype(np.uint64) + np.uint64(1))
    _, inverse, n_of = np.unique(keys, return_inverse=True, return_counts=True)
    return np.sort(at[n_of[inverse] > 1])


def _strings(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """The bytes of each run of windows: anchor, doc_id, first, count, string."""

    def run(batch: pa.RecordBatch):
        for doc, text, firsts, counts, anchors in zip(ids_of(batch), *(batch.column(x) for x in ("text", "firsts", "counts", "anchors"))):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            first, count = firsts.as_py(), counts.as_py()
            strings = pa.array([raw[f : f + n - 1 + window] for f, n in zip(first, count)], pa.binary())
            yield pa.RecordBatch.from_arrays([anchors.values, pa.array([doc] * len(first), pa.int64()), pa.array(first, pa.int32()), pa.array(count, pa.int32()), strings], names=["anchor", "doc_id", "first", "count", "string"])

    texts = docs.join(runs, docs["doc_id"] == runs["span_doc"]).select("doc_id", "text", "firsts", "counts", "anchors")
    return map_batches(texts, run, "anchor long, doc_id long, first int, count int, string binary")


def _by_suffix_arrays(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """Runs (doc_id, first, count) of the windows of places (anchor, doc_id, first, count) that stand in another of them: equal
    windows have equal anchors, which are dealt into buckets of some BUCKET_BYTES."""

    def resolve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        strings = [x.as_py() for x in table.column("string")]
        ends = np.cumsum([len(x) for x in strings])
        begins = np.concatenate([[0], ends[:-1]])
        counts = np.asarray(table.column("count"), dtype=np.int64)
        found = repeated_windows(np.frombuffer(b"".join(strings), dtype=np.uint8), begins, ends, counts, window)
        of = np.searchsorted(ends, found, side="right")
        cuts = np.flatnonzero((np.diff(found, prepend=-9) != 1) | (np.diff(of, prepend=-9) != 0))
        of, starts = of[cuts], found[cuts]
        lengths = np.diff(np.append(cuts, len(found)))
        first = np.asarray(table.column("first"), dtype=np.int64)[of] + starts - begins[of]
        return pa.table({"doc_id": np.asarray(table.column("doc_id"))[of], "first": first.astype(np.int32), "count": lengths.astype(np.int32)})

    size = places.agg(F.coalesce(F.sum(F.col("count") + (window - 1)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-size // BUCKET_BYTES))
    strings = _strings(docs, spans_of(places, "anchor"), window)
    dealt = strings.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(resolve, "doc_id long, first int, count int")


def _blocks(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """Runs of windows cut into blocks that stand at multiples of FRINGE + 1 from their anchor: core (hash
    of the bytes that all windows of a whole block share), the fringes to both sides as far as the
    run's windows reach, doc_id, at (the core's first byte)."""
    step, core = FRINGE + 1, window - FRINGE

    def run(batch: pa.RecordBatch):
        out: list[tuple] = []
        for doc, text, firsts, counts, places in zip(ids_of(batch), *(batch.column(x) for x in ("text", "firsts", "counts", "places"))):
            data = as_bytes(text.as_py())
            raw = data.tobytes()
            hasher = RunHasher(byte_units(data))
            for first, count, place in zip(firsts.as_py(), counts.as_py(), places.as_py()):
                last = first + count - 1
                start = first + (place - first) % step
                at = np.arange(start, last + step, step)
                at = at[at + core <= len(raw)]
                hashes = signed(hasher.runs(at, at + core))
                for a, h in zip(at.tolist(), hashes.tolist()):
                    left = raw[max(a - FRINGE, first) : a]
                    right = raw[a + core : min(a, last) + window]
                    out.append((h, left, right, doc, a))
        if out:
            h, left, right, doc, at = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(doc, pa.int64()), pa.array(at, pa.int64())], names=["core", "left", "right", "doc_id", "at"])

    texts = docs.join(runs, docs["doc_id"] == runs["span_doc"]).select("doc_id", "text", "firsts", "counts", "places")
    return map_batches(texts, run, "core long, left binary, right binary, doc_id long, at long")


def _by_aggregates(docs: DataFrame, places: DataFrame, window: int, name: str) -> DataFrame:
    """The same by blocks of windows, and where fringes of equal blocks differ, by single windows: no group of any key is gathered."""
    blocks = written(_blocks(docs, spans_of(places, "place"), window), f"{name}-blocks")
    fringe = F.xxhash64("left", "right")
    blocks_of = blocks.withColumns({"fringe": fringe, "windows": F.expr(f"length(left) + least({FRINGE}, length(right)) - {FRINGE} + 1")}).where("windows > 0")
    cores = written(blocks_of.groupBy("core").agg(F.count("*").alias("n"), (F.min("fringe") != F.max("fringe")).alias("several")).where("n > 1").select("core", "several"), f"{name}-core-counts")
    live = written(blocks_of.join(cores, "core"), f"{name}-cores")
    dropped(blocks)
    dropped(cores)
    run = (F.col("doc_id"), (F.col("at") - F.length("left")).cast("int").alias("first"), F.col("windows").cast("int").alias("count"))
    equal = live.where("not several").select(*run)
    # where fringes differ, equal ones are whole repeats, and one block of each is opened
    mixed = live.where("several")
    fringes = written(mixed.groupBy("core", "fringe").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at", "left", "right")).alias("b")).select("core", "fringe", "n", "b.*"), f"{name}-fringes")
    alike = mixed.join(fringes.where("n > 1").select("core", "fringe"), ["core", "fringe"]).select(*run)
    # A window of a block is its core with the last j bytes of the left fringe and FRINGE - j of the right.
    j = F.explode(F.expr(f"sequence({FRINGE} - least({FRINGE}, length(right)), length(left))")).alias("j")
    single = written(
        fringes.select("core", "left", "right", "doc_id", "at", j).select(
            "doc_id", (F.col("at") - F.col("j")).cast("int").alias("first"), F.expr(f"xxhash64(core, j, substring(left, length(left) - j + 1, j), substring(right, 1, {FRINGE} - j))").alias("hash"), "core"
        ),
        f"{name}-windows",
    )
    twice = written(single.groupBy("core", "hash").agg(F.count("*").alias("n")).where("n > 1").select("core", "hash"), f"{name}-twice")
    found = single.join(twice, ["core", "hash"]).select("doc_id", "first", F.lit(1).alias("count"))
    return equal.union(alike).union(found)


def repeated_spans(docs: DataFrame, window: int = 400, k: int = 48, name: str = "suffix") -> DataFrame:
    """Runs of windows (doc_id, first, count), in bytes, whose string also starts in another place, the same document included.

    docs: doc_id, text, each doc_id with one text. Contexts of anchors that stand in two places as a whole need no array; of each, one
    goes into it if its anchor has other contexts too.
    """
    places = seed(docs, byte_units, window, k, by_sorting, name)
    whole = places.where("n > 1").select("doc_id", "first", "count")
    alone = places.where("several and doc_id = least").select("anchor", "doc_id", "first", "count", "place")
    contexts = alone.groupBy("anchor").agg(F.count("*").alias("contexts"))
    alone = written(alone.join(contexts, "anchor"), f"{name}-open")
    out = whole.union(written(_by_suffix_arrays(docs, alone.where(F.col("contexts") <= MAX_CONTEXTS), window), f"{name}-repeats"))
    common = alone.where(F.col("contexts") > MAX_CONTEXTS)
    if common.limit(1).count():
        out = out.union(_by_aggregates(docs, common, window, name))
    return out


def suffix_dedup(docs: DataFrame, window: int = 400, k: int = 48) -> DataFrame:
    """Removes every byte that is covered by a string of `window` bytes that also starts anywhere else.

    Returns doc_id, kept (binary: the remaining bytes; a cut may fall inside a character), n_bytes, n_removed, n_spans
    (maximal removed runs). A null text is empty; shorter texts than `window` stay whole. All copies of a
    repeated string go, the first too. Very long texts are read whole. Rows that repeat a doc_id are separate texts, and copies of one row repeat each other.
    A null doc_id is a document like any other. Other columns are ignored. An empty table gives an empty one.
    """
    docs = text_of(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    spans = spans_of(repeated_spans(docs.select(F.col("row_key").alias("doc_id"), "text"), window, k))
    texts = sized(docs.join(spans, docs["row_key"] == spans["span_doc"], "left").select("doc_id", "text", "firsts", "counts"))

    def cut(batch: pa.RecordBatch):
        kept, n_bytes, n_removed, n_spans = [], [], [], []
        for text, firsts, counts in zip(*(batch.column(x) for x in ("text", "firsts", "counts"))):
            data = as_bytes(text.as_py())
            gone = removed_units(firsts, counts, window, len(data))
            kept.append(data[~gone].tobytes())
            n_bytes.append(len(data))
            n_removed.append(int(gone.sum()))
            n_spans.append(int(np.count_nonzero(np.diff(gone, prepend=False) & gone)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return map_batches(texts, cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
