"""Byte-level BPE with word ends: encoding by batched merge rounds over flat arrays, and decoding."""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.frames import map_batches, text_of

#: Words that a Python worker remembers between batches; words of over LONG_WORD characters are not remembered.
REMEMBERED, LONG_WORD = 200_000, 64
#: Code points of a text that are split into words at once; cuts are made at spaces and line breaks only.
PART = 1 << 20
#: Symbols from which a single word is merged from a heap: the rounds of one word are as many as its different merges.
HEAP_FROM = 4096
#: Fixed: what such a file splits words by.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose class and lower case all versions of Unicode tables agree on (a test compares them with the library's).
PLAIN = regex.compile(r"[\x00-ԯ‐-‧‰-⁞€、-〃ぁ-ゖァ-ヺ一-龥가-힣]*")
NONE = np.int64(1) << 40


class Bpe:
    """A vocabulary file, its merges as sorted pair keys.

    Only files of one shape are read: NFC, white space and lower case, words by SPLIT, byte-level symbols, an end of word
    on each word's last symbol, no decoder; others are an error. Each merge must make a symbol of its own from
    symbols made before it: then a merge never makes a pair of lower rank, and all occurrences of a word's
    lowest pair can be merged in one round.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, parts = spec["model"], [x.get("pattern", {}).get("Regex") or x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("invert"), x.get("use_regex"), x.get("add_prefix_space")) for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk"))
        if model["type"] != "BPE" or parts != ["NFC", r"\s+", "Lowercase"] or splits != [("Split", SPLIT, True, None, None), ("ByteLevel", None, None, False, False)] or spec["decoder"] or not plain:
            raise ValueError(f"{path} is no vocabulary of the shape that is read here.")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take in what stands around them.")
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.split = regex.compile(SPLIT)
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in (ids | self.special).items()}
        # byte-level files write printable bytes as themselves and the others as 256, 257, ...
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.byte_of = {c: b for b, c in chars.items()}
        self.inner = np.array([ids[chars[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([ids[chars[b] + end] for b in range(256)], dtype=np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = np.int64(max(self.token) + 1)
        left, right = (np.array([ids[m[side]] for m in merges], dtype=np.int64) for side in (0, 1))
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        birth = np.full(self.base, -1, dtype=np.int64)
        birth[self.made] = np.arange(len(merges))
        if len(np.unique(self.made)) < len(merges) or (birth[left] >= np.arange(len(merges))).any() or (birth[right] >= np.arange(len(merges))).any() or (birth[self.inner] >= 0).any() or (birth[self.last] >= 0).any():
            raise ValueError(f"{path} has merges that are out of order or make a symbol twice.")
        order = np.argsort(left * self.base + right)
        self.keys, self.ranks = (left * self.base + right)[order], order.astype(np.int64)
        self.known: dict[str, tuple[bytes, str]] = {}

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols by binary search over the sorted pair keys; NONE if they don't merge."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        pairs = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], NONE)

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each of some non-empty words: in each round every word's lowest-rank pair is merged wherever it stands."""
        done: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        for n, word in enumerate(words):
            if len(word) > HEAP_FROM:
                done[n] = self.merged_from_heap(word)
        some = [n for n, word in enumerate(words) if 0 < len(word) <= HEAP_FROM]
        if not some:
            return done
        sizes = np.array([len(words[n]) for n in some])
        of = np.repeat(np.array(some), sizes)  # the word of each symbol
        flat = np.frombuffer(b"".join(words[n] for n in some), dtype=np.uint8)
        ends = np.cumsum(sizes) - 1
        symbols = self.inner[flat]
        symbols[ends] = self.last[flat[ends]]
        rank = np.full(len(symbols), NONE)  # of the pair of a symbol and the next one of its word
        inside = of[1:] == of[:-1]
        rank[:-1][inside] = self.ranked(symbols[:-1][inside], symbols[1:][inside])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            sizes = np.diff(np.append(starts, len(of)))
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                for s, n in zip(starts[over], sizes[over]):
                    done[of[s]] = symbols[s : s + n]
                live = np.repeat(~over, sizes)
                symbols, of, rank, sizes, least = symbols[live], of[live], rank[live], sizes[~over], least[~over]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            # of pairs that overlap, as in a a a, every second one from the left
            fresh = np.concatenate([[True], (np.diff(hits) > 1) | (of[hits[1:]] != of[hits[:-1]])])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
            symbols[hits] = self.made[rank[hits]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[hits + 1] = False
            place = np.cumsum(stay) - 1
            symbols, of, rank = symbols[stay], of[stay], rank[stay]
            changed = np.unique(np.concatenate([place[hits], np.maximum(place[hits] - 1, 0)]))
            pairs = changed[changed + 1 < len(of)]
            pairs = pairs[of[pairs] == of[pairs + 1]]
            rank[changed] = NONE
            rank[pairs] = self.ranked(symbols[pairs], symbols[pairs + 1])
        return done

    def merged_from_heap(self, word: bytes) -> np.ndarray:
        """The same ids for one very long word, pair by pair from a heap by rank and place."""
        flat = np.frombuffer(word, dtype=np.uint8)
        symbols = self.inner[flat]
        symbols[-1] = self.last[flat[-1]]
        first = self.ranked(symbols[:-1], symbols[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first < NONE)]
        heapq.heapify(heap)
        sym, n = symbols.tolist(), len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank_at, base = first.tolist() + [int(NONE)], int(self.base)
        rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))

        def look(i: int) -> None:
            j = after[i]
            rank_at[i] = rank_of.get(sym[i] * base + sym[j], int(NONE)) if j >= 0 else int(NONE)
            if rank_at[i] < NONE:
                heapq.heappush(heap, (rank_at[i], i))

        while heap:
            rank, i = heapq.heappop(heap)
            if sym[i] < 0 or rank_at[i] != rank:
                continue
            j = after[i]
            sym[i], sym[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return np.array([s for s in sym if s >= 0], dtype=np.int64)

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens, in lower case."""
        if PLAIN.fullmatch(text):
            return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        # other characters: by the library's own tables, whose version may be another one
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte_of[c] for c in piece).decode("utf-8") for piece, _ in pieces]

    def learned(self, words: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """ids (little-endian) and decoded text of the words that are not remembered, merged together; short ones are remembered from then on."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        long: dict[str, tuple[bytes, str]] = {}
        for w, ids in zip(new, self.merged([w.encode() for w in new])):
            entry = ids.astype("<u4").tobytes(), " ".join(map(self.token.__getitem__, ids.tolist()))
            (self.known if len(w) <= LONG_WORD else long)[w] = entry
        return long

    def encoded(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """ids (little-endian unsigned 32-bit) of each text, and the text that they decode to; some PART characters are merged together."""
        found: list[tuple[list[bytes], list[str]]] = [([], []) for _ in texts]
        waiting: list[tuple[int, list[str], str | None]] = []  # text, words, the special token behind them

        def settle() -> None:
            long = self.learned(w for _, words, _ in waiting for w in words)
            for n, words, special in waiting:
                entries = [self.known.get(w) or long[w] for w in words]
                if special is not None:
                    entries.append((self.special[special].to_bytes(4, "little"), special))
                if entries:
                    found[n][0].append(b"".join(ids for ids, _ in entries))
                    found[n][1].append(" ".join(text for _, text in entries))
            waiting.clear()

        size = 0
        for n, text in enumerate(texts):
            for part in parts_of(text):
                at = 0
                for special in [*(self.specials.finditer(part) if self.specials else ()), None]:
                    waiting.append((n, self.words(part[at : special.start() if special else len(part)]), special and special[0]))
                    at = special.end() if special else at
                size += len(part)
                if size >= PART:
                    settle()
                    size = 0
        settle()
        return [(b"".join(ids), " ".join(texts)) for ids, texts in found]

    def decoded(self, ids: bytes) -> str:
        """The text of ids, special tokens included; ids that the file lacks are passed over, as the library does."""
        return " ".join(self.token[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i in self.token)


def parts_of(text: str) -> Iterator[str]:
    """A text in parts of some PART characters, cut before a space or line break: no word, special token or composed character crosses these."""
    at = 0
    while len(text) - at > PART:
        cut = max(text.rfind(" ", at + 1, at + PART), text.rfind("\n", at + 1, at + PART))
        if cut < 0:
            after = [x for x in (text.find(" ", at + PART), text.find("\n", at + PART)) if x >= 0]
            cut = min(after, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def _path(tokenizer: str | None) -> str:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return tokenizer


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (their text) of every whole text.

    `tokenizer` is the path of a BPE file with word ends on all executors, by default the public word_bpe_49k.json. The ids are the
    tokenizers library's without added special tokens; those that stand in a text are encoded as themselves. A null or empty
    text, or one of white space, has no tokens and decodes to "". Very long texts are split in parts at spaces, so what a task
    holds at once follows the longest word, not the text. Repeated rows and null ids are encoded like others;
    other columns are ignored. An empty table gives an empty one. Nothing is shuffled.
    """
    path = _path(tokenizer)

    def run(batch: pa.RecordBatch):
        found = vocabulary(path).encoded(batch.column("text").to_pylist())
        ids = pa.array([x for x, _ in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x, _ in found], pa.int64()), ids, pa.array([t for _, t in found], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return map_batches(text_of(docs), run, "doc_id long, n_tokens long, ids binary, decoded string")


def decode(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and decoded of rows with doc_id and ids (as encode gives them): tokens, special ones included, joined by spaces. Null ids decode to ""."""
    path = _path(tokenizer)

    def run(batch: pa.RecordBatch):
        texts = [vocabulary(path).decoded(ids.as_py()) for ids in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return map_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.lit(b"")).alias("ids")), run, "doc_id long, decoded string")


def digest(rows: DataFrame) -> DataFrame:
    """What the query returns of encode()'s rows."""
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
