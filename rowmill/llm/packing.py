"""Best-fit packing of tokenised documents, improved by a swap-based local search."""

from __future__ import annotations

import functools
import json
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.frames import map_batches, text_of, written

#: Pieces that one task packs together at most, on average; what its last bins leave open is packed again.
BUCKET = 8192
#: Splits a text before merges; the pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoders(path: str):
    """A byte-level BPE file, as read by tokenizers, and the same vocabulary in the faster tiktoken.

    Both give the same ids (tests compare them); tiktoken takes a third of the time.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    # byte-level BPE writes printable bytes as themselves and the others as 256, 257, ...
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return slow, fast


def token_ids(text: str, path: str, end_id: int = 2) -> np.ndarray:
    """Ids of a text without special tokens added, then end_id."""
    slow, fast = encoders(path)
    try:
        ids = fast.encode(text, allowed_special="all")
    except (ValueError, RuntimeError):  # a run without a break that its pattern engine can't hold
        ids = slow.encode(text, add_special_tokens=False).ids
    ids.append(end_id)
    return np.array(ids, dtype="<u4")


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents of more than capacity tokens are cut, the first piece being the shorter one."""

    def run(batch: pa.RecordBatch):
        rows: list[tuple] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = token_ids(text.as_py(), path)
            first = len(ids) % capacity or capacity
            starts = [0, *range(first, len(ids), capacity)]
            for i, (start, end) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                rows.append((doc, i, start, end - start, zlib.crc32(ids[start:end].tobytes())))
        doc, piece, start, length, crc = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers): items in descending order, each into the fullest bin that it fits."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g: some bin has a gap of g
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        fits = open_gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        by_gap[gap - n].append(b)
        open_gaps |= 1 << (gap - n)
    return bins


def _smeared(bits: int, most: int) -> int:
    """Bits moved up by 1 to `most` places, all of them together."""
    out, width = bits << 1, 1
    while width < most:
        step = min(width, most - width)
        out |= out << step
        width += step
    return out


def _sums(lengths: list[int]) -> int:
    """Bit n: one item or two of the lengths make n."""
    one = two = 0
    for n in lengths:
        two |= one << n
        one |= 1 << n
    return one | two


def _items_of(total: int, items: list[int], lengths: list[int]) -> list[int]:
    """One item or two whose lengths make total, one if possible."""
    seen: dict[int, int] = {}
    pair: list[int] = []
    for i in items:
        if lengths[i] == total:
            return [i]
        if not pair and total - lengths[i] in seen:
            pair = [seen[total - lengths[i]], i]
        seen[lengths[i]] = i
    return pair


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Moves one item or two, or swaps one or two for one, from emptier bins to fuller ones while the sum of squared fills grows.

    Only underfull bins take part. Donors go from the emptiest up, and each gives as long as any bin as full or fuller can
    take from it, what fills that bin best. Ends when no donor can give any more: every exchange
    raises the sum of squares by 2 * gain * (fill of receiver - fill of donor + gain) > 0.
    """
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    sums = [_sums([lengths[i] for i in b]) for b in bins]
    # totals that a bin gains from: more than nothing or than one of its items, and no more than its gap above that
    wants = [0] * len(bins)

    def settle(b: int) -> None:
        sums[b] = _sums([lengths[i] for i in bins[b]])
        gap = capacity - fill[b]
        wants[b] = _smeared(sum(1 << n for n in {0, *(lengths[i] for i in bins[b])}), gap) if gap > 0 and bins[b] else 0

    for b in range(len(bins)):
        settle(b)
    changed = True
    while changed:
        changed = False
        order = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=fill.__getitem__)
        for at, donor in enumerate(order):
            for receiver in reversed(order[at + 1 :]):
                while bins[donor] and sums[donor] & wants[receiver] and fill[receiver] >= fill[donor]:
                    gap, best, back = capacity - fill[receiver], 0, None
                    for i in [None, *bins[receiver]]:
                        n = 0 if i is None else lengths[i]
                        gain = ((sums[donor] & ((1 << (n + gap + 1)) - 1)).bit_length() - 1) - n
                        if gain > best:
                            best, back = gain, i
                    given = _items_of(best + (0 if back is None else lengths[back]), bins[donor], lengths)
                    bins[receiver] += given
                    bins[donor] = [i for i in bins[donor] if i not in given]
                    if back is not None:
                        bins[receiver].remove(back)
                        bins[donor].append(back)
                    fill[receiver] += best
                    fill[donor] -= best
                    settle(receiver)
                    settle(donor)
                    changed = True
    return [b for b in bins if b]


def _packed(rows: DataFrame, capacity: int, level: int) -> DataFrame:
    """Adds sequence_id, offset and fill to pieces shorter than capacity, bucket by bucket."""
    buckets = max(1, math.ceil(rows.count() / BUCKET))
    base = level << 60

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = group["length"].tolist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        of = np.zeros(len(group), dtype=np.int64)
        offset = np.zeros(len(group), dtype=np.int64)
        fill = np.zeros(len(group), dtype=np.int64)
        for n, items in enumerate(bins):
            sizes = [lengths[i] for i in items]
            of[items] = n
            offset[items] = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            fill[items] = sum(sizes)
        bucket = int(group["bucket"].iloc[0])
        return group.drop(columns="bucket").assign(sequence_id=base + bucket * (1 << 20) + of, offset=offset, fill=fill)

    kept = rows.select("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"
    return dealt.groupBy("bucket").applyInPandas(pack, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, refill: float = 0.97) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens, as few as it can.

    Returns for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. `tokenizer` is the path of a
    byte-level BPE file, by default the public byte_bpe_50k.json. A null or empty text is the end token alone.
    Full pieces are sequences of their own; the others are dealt into buckets of some thousand, packed best
    fit, then improved by local search; sequences filled below `refill` are opened and packed
    again over all buckets. Repeated rows and null ids are packed like others. Other columns are ignored. An
    empty table gives an empty one.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    all_pieces = written(pieces(text_of(docs), tokenizer, capacity), "pieces")
    full = all_pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    once = written(_packed(all_pieces.where(F.col("length") < capacity), capacity, 0), "packed")
    low = F.col("fill") < refill * capacity
    again = written(_packed(once.where(low), capacity, 1), "repacked")
    return full.unionByName(once.where(~low).drop("fill")).unionByName(again.drop("fill"))
