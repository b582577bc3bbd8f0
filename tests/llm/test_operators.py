"""Each operator against brute force, on texts with nulls, copies, ties, repeated rows and clashing columns."""

import dataclasses
import hashlib
import inspect
import itertools
import os
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from unittest.mock import MagicMock

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowmill.llm import decontaminate, kernels, line_dedup, minhash_dedup, packing, pii, quality_rules, queries, secrets, substring_dedup, suffix_dedup, toxicity

WORD = re.compile(r"[^ \t-\r]+")
SCHEMA = "doc_id long, text string, doc long, gone string, span_doc int, firsts string, node string, words string, items string"


def words_of(text):
    return WORD.findall(text or "")


def make(r, n, pool=400):
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(2, 8))) + r.choice(["", "", ",", "."]) for _ in range(n)) if pool else ""


@pytest.fixture(scope="module")
def corpus():
    """Texts by id: unique ones, exact and near copies, shared passages, periodic and long texts, blanks and nulls."""
    r = random.Random(5)
    base = [make(r, r.randint(5, 200)) for _ in range(24)]
    passage = make(r, 70)
    texts = list(base)
    texts += [base[0], base[0], base[1] + " tail", base[2].replace(",", "", 1)]
    for t in base[3:7]:
        w = t.split(" ")
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts += [make(r, 30) + "\n" + passage + "\n" + make(r, 40) for _ in range(5)]
    texts += ["ab " * 400, "ab " * 400 + "z", "x" * 1500, "x" * 900, None, "", " \n\t", "one", "\n".join([base[8]] * 3)]
    texts.append(" ".join(base) + passage)
    return dict(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, 1, "a", 2, "b", "c", "d", "e") for i, t in corpus.items()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, rows that repeat an id, null ids and null texts."""
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(1, long), (1, long), (1, None), (None, long), (None, None), (2, long + " more"), (2, "")]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in rows], SCHEMA)


def test_kernels_agree_with_python(corpus):
    for text in corpus.values():
        data = kernels.as_bytes(text)
        starts, ends = kernels.word_spans(data)
        raw = data.tobytes()
        assert [raw[s:e].decode() for s, e in zip(starts, ends)] == words_of(text)
        h = kernels.word_hashes(data, starts, ends)
        assert len(set(h.tolist())) == len(set(words_of(text)))


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_sliding_minimum(values, width):
    if len(values) >= width:
        got = kernels.sliding_min(np.array(values, dtype=np.uint64), width).tolist()
        assert got == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@given(st.lists(st.integers(0, 3), max_size=30))
@settings(max_examples=200, deadline=None)
def test_lyndon_suffix_array(text):
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@given(st.lists(st.integers(0, 3), max_size=30))
@settings(max_examples=100, deadline=None)
def test_previous_smaller_pointers(text):
    slots, pointers = suffix_dedup.lyndon_groups(text)
    for i in range(len(text)):
        assert pointers[i] == max((j for j in range(i) if text[j:] < text[i:]), default=-1)


def substring_truth(corpus, window):
    first = {}
    for i in sorted(corpus):
        w = words_of(corpus[i])
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = {}
    for i, t in corpus.items():
        w = words_of(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window, k", [(50, 10), (6, 3)])
def test_substring_dedup(docs, corpus, window, k):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digest(substring_dedup.substring_dedup(docs, window, k)).collect()}
    assert got == substring_truth(corpus, window)


@pytest.mark.parametrize("window, k", [(400, 48), (40, 8)])
def test_suffix_dedup(docs, corpus, window, k):
    counts = Counter()
    raw = {i: (t or "").encode() for i, t in corpus.items()}
    for b in raw.values():
        counts.update(b[s : s + window] for s in range(len(b) - window + 1))
    want = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - window + 1):
            if counts[b[s : s + window]] > 1:
                gone[s : s + window] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(suffix_dedup.suffix_dedup(docs, window, k)).collect()}
    assert got == want


def test_substring_dedup_of_common_anchors(docs, corpus, monkeypatch):
    """Anchors with more contexts than a bucket takes are resolved by aggregates, with the same result."""
    monkeypatch.setattr(substring_dedup, "MAX_CONTEXTS", 1)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digest(substring_dedup.substring_dedup(docs, 6, 3)).collect()}
    assert got == substring_truth(corpus, 6)


@given(st.randoms(use_true_random=False), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_matches_are_extended_both_ways(r, more):
    """Contexts around one anchor, all of whose windows hold it, against all windows."""
    anchor, window = [100, 101], 2 + more
    words, places, docs = [], [], []
    for _ in range(r.randint(1, 9)):
        n = r.randint(0, more)
        left, right = [r.randint(0, 1) for _ in range(n)], [r.randint(0, 1) for _ in range(r.randint(more - n, more))]
        words.append(np.array(left + anchor + right))
        places.append(n)
        docs.append(r.randint(0, 5))
    counts = [len(w) - window + 1 for w in words]
    got = substring_dedup.extended(words, np.array(places), np.array(docs), np.array(counts), window)
    for i, w in enumerate(words):
        smaller = {(s - places[j], tuple(v[s : s + window])) for j, v in enumerate(words) if docs[j] < docs[i] for s in range(counts[j])}
        assert got[i].tolist() == [(s - places[i], tuple(w[s : s + window])) in smaller for s in range(counts[i])]


def window_truth(strings, window):
    counts = Counter(s[i : i + window] for s in strings for i in range(len(s) - window + 1))
    begins = np.cumsum([0, *map(len, strings)]).tolist()
    return [b + i for s, b in zip(strings, begins) for i in range(len(s) - window + 1) if counts[s[i : i + window]] > 1]


def windows_by(strings, window, **more):
    ends = np.cumsum([len(s) for s in strings])
    begins = np.concatenate([[0], ends[:-1]])
    return suffix_dedup.repeated_windows(np.frombuffer(b"".join(strings), dtype=np.uint8), begins, ends, ends - begins - window + 1, window, **more).tolist()


def cut_strings(r, alphabet, window):
    base = [bytes(r.choice(alphabet) for _ in range(r.randint(window, 5 * window))) for _ in range(3)]
    for _ in range(r.randint(1, 8)):
        b = r.choice(base)
        i = r.randint(0, len(b) - window)
        x = bytearray(b[i : r.randint(i + window, len(b))])
        if r.random() < 0.4:
            x[r.randrange(len(x))] = r.choice(alphabet)
        yield bytes(x) + bytes(r.choice(alphabet) for _ in range(r.choice((0, 0, 9))))


@given(st.randoms(use_true_random=False), st.sampled_from([b"a", b"ab", b"abc", bytes(range(250))]), st.sampled_from([20, 40]))
@settings(max_examples=300, deadline=None)
def test_windows_of_a_suffix_array(r, alphabet, window):
    strings = list(cut_strings(r, alphabet, window))
    assert windows_by(strings, window) == window_truth(strings, window)


@pytest.mark.parametrize("most", [1, 7, 40, 400])
def test_common_prefixes_go_by_words_of_bytes(most):
    """Equal to a comparison of each byte, ends of the data included, and without a table of every byte."""
    r = np.random.default_rng(most)
    data = r.choice(np.array([0, 97, 255], dtype=np.uint8), 3000, p=[0.002, 0.996, 0.002])
    a, b = r.integers(0, 3000, (2, 5000))
    a[:50], b[25:75] = 2999, 2990
    ends = 3000 - r.integers(0, 2, (2, 5000)) * np.minimum(5, np.minimum(3000 - a, 3000 - b) - 1)
    tracemalloc.start()
    got = suffix_dedup._common_prefixes(data, a, b, ends[0] - a, ends[1] - b, most).tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    raw = data.tobytes()
    for x, y, end_x, end_y, n in zip(a.tolist(), b.tolist(), *ends.tolist(), got):
        left, right = raw[x : min(end_x, x + most)], raw[y : min(end_y, y + most)]
        assert n == len(os.path.commonprefix([left, right]))
    assert peak < 16 << 20


def test_the_order_of_suffixes_decides():
    """An order by the first symbol alone finds less than the suffix array."""
    r = random.Random(6)
    by_symbol = lambda text: sorted(range(len(text)), key=lambda i: (text[i], -i % 7))
    less = 0
    for _ in range(30):
        strings = list(cut_strings(r, b"ab", 40))
        found, truth = windows_by(strings, 40, array_of=by_symbol), window_truth(strings, 40)
        assert windows_by(strings, 40) == truth and set(found) <= set(truth)
        less += len(found) < len(truth)
    assert less > 0


def test_suffix_dedup_of_common_anchors(docs, monkeypatch):
    """Anchors with more contexts than a bucket takes are resolved by aggregates, with the same result."""
    rows = lambda: sorted(suffix_dedup.digest(suffix_dedup.suffix_dedup(docs, 40, 8)).collect())
    by_arrays = rows()
    monkeypatch.setattr(suffix_dedup, "MAX_CONTEXTS", 1)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 12)
    assert rows() == by_arrays


def test_suffix_dedup_goes_by_bytes_not_words(spark):
    """A passage of 67 words that two documents share stays if it is 399 bytes long, and goes from both at 400."""
    r = random.Random(9)
    short, long = (" ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(66)) + end for end in (" xyz", " wxyz"))
    assert (len(short), len(long), len(short.split())) == (399, 400, 67)
    rows = [(i, f"{make(r, 90)} {i}{passage}{i} {make(r, 90)}") for i, passage in enumerate([short, short, long, long])]
    result = suffix_dedup.digest(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in result.collect()} == {0: (0, 0), 1: (0, 0), 2: (400, 1), 3: (400, 1)}


def shingles(text, k):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words_of(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def component_truth(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


def test_minhash_dedup(docs, corpus):
    sets = {i: shingles(t, 4) for i, t in corpus.items()}
    truth = component_truth(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.minhash_dedup(docs, shingle=4).collect()}
    assert got == {i: (len(s), truth[i], truth[i] == i) for i, s in sets.items()}


def test_minhash_dedup_of_a_graded_group(spark):
    """Many variants of one text with ever more edits: links at the threshold, and members that no table connects."""
    r = random.Random(3)
    base = make(r, 120).split(" ")
    texts = {}
    for i in range(90):
        w = list(base)
        for at in r.sample(range(len(w)), r.randint(0, 9)):
            w[at] = f"e{r.randint(0, 10**6)}"
        texts[i] = " ".join(w)
    truth = component_truth({i: shingles(t, 4) for i, t in texts.items()})
    rows = minhash_dedup.minhash_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == truth


def test_links_of_a_near_group_are_followed_once(spark, monkeypatch):
    """What goes into the propagation of components follows the members of a group, not their links, and no later turn takes them again."""
    r = random.Random(11)
    base = make(r, 160).split(" ")
    texts = {}
    for i in range(200):
        w = list(base)
        for at in r.sample(range(len(w)), r.randint(0, 6)):
            w[at] = f"e{r.randint(0, 10**6)}"
        texts[i] = " ".join(w)
    followed = []
    components = minhash_dedup.components
    monkeypatch.setattr(minhash_dedup, "components", lambda edges: (followed.append(edges.count()), components(edges))[1])
    rows = minhash_dedup.minhash_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == component_truth({i: shingles(t, 4) for i, t in texts.items()})
    assert 0 < sum(followed) <= 2 * len(texts)


def edits(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return 2
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b))
    return 1 if any(b[:i] + b[i + 1 :] == a for i in range(len(b))) else 2


def test_line_dedup(spark):
    r = random.Random(8)
    pool = [make(r, n) for n in (3, 5, 9, 12, 8, 16, 17, 15, 31, 32, 33)]
    lines = list(pool)
    for t in pool:
        w = t.split(" ")
        at = r.randrange(len(w))
        lines += [" ".join(w[:at] + ["new"] + w[at + 1 :]), " ".join(w[:at] + w[at + 1 :]), " ".join(w[:at] + ["in"] + w[at:]), " ".join([*w[:1], "x", *w[1:-1], "y"])]
    texts = {i: "\n".join(r.choice(lines) for _ in range(r.randint(1, 6))) for i in range(40)}
    texts |= {40: None, 41: "", 42: "\n\n"}
    order = [(i, p, tuple(x.split())) for i in sorted(texts) for p, x in enumerate((texts[i] or "").split("\n"))]
    gone = Counter()
    for n, (i, p, w) in enumerate(order):
        if w and any(w == v or len(w) >= 8 and len(v) >= 8 and edits(w, v) <= 1 for _, _, v in order[:n]):
            gone[i] += 1
    rows = line_dedup.line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), max_change=1 / 8).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {i: gone[i] for i in texts}
    assert all(r["n_lines"] - r["n_removed"] == r["text"].count("\n") + 1 or not r["text"] for r in rows)


def test_line_dedup_of_short_lines(spark, tmp_path):
    """The registered query: copies of lines of any number of words, and lines of 4 to 7 words one edit apart."""
    r = random.Random(9)
    pool = [make(r, n) for n in (1, 1, 2, 3, 4, 4, 5, 6, 7, 8)]
    lines = [*pool, "", " \t"]
    for t in pool:
        w = t.split(" ")
        at = r.randrange(len(w))
        lines += [" ".join(w[:at] + ["new"] + w[at + 1 :]), " ".join(w[:at] + ["in"] + w[at:]), " ".join(w[:at] + w[at + 1 :])]
    texts = {i: "\n".join(r.choice(lines) for _ in range(r.randint(1, 3))) for i in range(30)}
    order = [(i, tuple(x.split())) for i in sorted(texts) for x in texts[i].split("\n")]
    gone = Counter()
    for n, (i, w) in enumerate(order):
        if w and any(w == v or len(w) >= 4 and len(v) >= 4 and edits(w, v) <= 1 for _, v in order[:n]):
            gone[i] += 1
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op1_line_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {i: gone[i] for i in texts}


def test_packing_round_trip(spark, docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    import zlib

    total = 0
    for i, t in corpus.items():
        ids = np.array(slow.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        total += len(ids)
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert sum(p["length"] for p in parts) == len(ids) and all(p["length"] == 1024 for p in parts[1:])
        for p in parts:
            assert zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert len(by_sequence) <= -(-total // 1024) + 2


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_both_tokenizers_give_the_same_ids(text):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, _ = packing.encoders(path)
    assert packing.token_ids(text + "<|endoftext|>", path).tolist() == [*slow.encode(text + "<|endoftext|>", add_special_tokens=False).ids, 2]


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=100, deadline=None)
def test_local_search_never_loses_items(lengths):
    first = packing.best_fit(lengths, 50)
    n = len(first)
    bins = packing.local_search(first, lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins) and len(bins) <= n


@given(st.lists(st.integers(1, 12), min_size=2, max_size=14), st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_local_search_ends_where_no_exchange_helps(lengths, r):
    bins = [[i] for i in range(len(lengths))]
    for _ in range(6):
        a, b = r.sample(range(len(bins)), 2)
        if sum(lengths[i] for i in bins[a] + bins[b]) <= 12:
            bins[a], bins[b] = bins[a] + bins[b], []
    out = packing.local_search([b for b in bins if b], lengths, 12)
    fill = [sum(lengths[i] for i in b) for b in out]
    for a, b in itertools.permutations(range(len(out)), 2):  # from a to b
        if fill[a] <= fill[b] < 12:
            for given_up in [*itertools.combinations(out[a], 1), *itertools.combinations(out[a], 2)]:
                for back in [0, *(lengths[i] for i in out[b])]:
                    assert not 0 < sum(lengths[i] for i in given_up) - back <= 12 - fill[b] or fill[a] == fill[b]


def test_local_search_empties_bins():
    lengths = [6, 6, 4, 3, 3, 2]
    bins = packing.local_search([[0, 3], [1, 4], [2, 5]], lengths, 12)
    assert len(bins) == 2 or sum(sum(lengths[i] for i in b) ** 2 for b in bins) > 81 + 81 + 36


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def pii_truth(text):
    out = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out)


@given(st.text(alphabet="a.@-+_ 0123459()\n%é", max_size=60))
@settings(max_examples=400, deadline=None)
def test_pii_patterns(text):
    assert sorted(pii.base_spans(text)) == pii_truth(text)


def test_pii_field_finds_cards_in_a_row(spark):
    card, other = "4539578763621486", "4485275742308327"
    assert pii.luhn(card) and pii.luhn(other)
    r = random.Random(1)
    rows = [(i, f"{make(r, 12)} pay {card} {make(r, 5)} call +1 (437) 555-0689 or x{i}@mail.example.com at 10.1.2.{i} in {r.randint(1, 99)} days") for i in range(40)]
    rows.append((99, f"words {card} {other} then {card} end"))
    out = {r["doc_id"]: r for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["n_card"] == out[0]["n_phone"] == out[0]["n_email"] == out[0]["n_ip"] == 1
    assert out[99]["n_card"] == 1
    assert {"card:6:22", "card:23:39", "card:45:61"} <= set(out[99]["spans"].split(","))
    assert all(b in r["spans"].split(",") for r in out.values() for b in r["base"].split(",") if b)


def test_skip_edges_find_second_mentions():
    """A number that the patterns know by its country code is found again without it, by its equal tokens alone."""
    r = random.Random(3)
    texts = [f"{make(r, 9)} call +1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)} or {make(r, 3)} x{i}@mail.example.com {make(r, 4)} 10.1.{i}.7 in {r.randint(1, 99)} days of {r.randint(1900, 2020)} {make(r, 5)}" for i in range(60)]
    field = pii.train([pii.stretch(t, 256) for t in texts])
    without = dataclasses.replace(field, same=0 * field.same, shape=0 * field.shape)
    wanted = found = chain_only = extra = 0
    for i in range(40):
        a, b = r.randint(200, 999), r.randint(1000, 9999)
        text = f"{make(r, 6)} call +1 ({a}) 555-{b} now {make(r, 8)} again ({a}) 555-{b} {make(r, 4)} {r.randint(1, 99)} days, {r.randint(1900, 2020)}"
        base = pii.base_spans(text)
        at = text.rindex(f"{a}) 555-{b}")
        spans = pii.crf_spans(text, field, base)
        wanted += 1
        found += ("phone", at, at + len(f"{a}) 555-{b}")) in spans
        extra += sum(s != ("phone", at, at + len(f"{a}) 555-{b}")) for s in spans)
        chain_only += len(pii.crf_spans(text, without, base))
    assert found >= 0.9 * wanted and extra == 0 and chain_only == 0


def test_training_looks_at_all_parts_of_a_text():
    text = " ".join(f"{i}@x.example.com" for i in range(1000))
    places = {pii.stretch(text + " " * i, 10).labels.count(1) for i in range(5)}
    assert places == {10} and len(pii.stretch(text, 5000).labels) == 1000


def test_marginals_of_a_tree_are_exact():
    """Message passing against the sum over all labellings."""
    r = np.random.default_rng(5)
    nodes = pii.Nodes([(0, 1)] * 4, [[0], [1], [2], [3]], [(0, 1), (1, 2)], [(0, 3)], [])
    field = pii.Field(r.standard_normal((40, 5)), *r.standard_normal((3, 5, 5)))
    total = np.zeros((4, 5))
    for labels in itertools.product(range(5), repeat=4):
        z = sum(field.unary[i, a] for i, a in enumerate(labels)) + sum(field.chain[labels[i], labels[j]] for i, j in nodes.chain) + field.same[labels[0], labels[3]]
        for i, a in enumerate(labels):
            total[i, a] += np.exp(z)
    assert np.allclose(pii.infer(field, nodes, rounds=60), total / total.sum(axis=1, keepdims=True), atol=1e-3)


def test_pii_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 50_000, "@" * 100_000):
        pii.base_spans(text)


SECRETS = {
    "assign": re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


@given(st.lists(st.sampled_from(["Token", "api_key", "apikey", "PASSWORD", "=", ":", " ", '"', "abc", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "\n", "x"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_secret_patterns(parts):
    text = "".join(parts)
    want = [("assign", *m.span()) for m in SECRETS["assign"].finditer(text) if len(m[2]) >= 6]
    want += [("access", *m.span()) for m in SECRETS["access"].finditer(text) if len(m[0]) >= 20]
    want += [("hex", *m.span()) for m in SECRETS["hex"].finditer(text) if len(m[0]) >= 24]
    assert sorted(secrets.base_spans(text)) == sorted(want)


def test_secret_lexer_propagates_constants():
    literal = "Zx8Qm2Lp9Rt4Wv7Y"
    for text in (f'K = "{literal}"\nlogin_pwd = K\n', f"a = '{literal[:8]}' + '{literal[8:]}'\nb = a\nclientSecret: b", f'"auth_credential": "{literal}"'):
        spans = secrets.lexed_spans(text, secrets.base_spans(text))
        assert len(spans) == 1 and text[spans[0][1] : spans[0][2]].startswith(literal[:8])
    for text in (f'title = "{literal}"', "password_hint = K", 'name = "plain words here"'):
        assert secrets.lexed_spans(text, []) == []


#: Text, and the literals that the lexer adds.
LEXED = [
    ('db_pwd = "abc\\"Zk39 x"', ['abc\\"Zk39 x']),
    ('pwd = """two\nlines here"""', ["two\nlines here"]),
    ("pwd = `back tick 1`", ["back tick 1"]),
    ("<dbPwd>hunter2hunter</dbPwd>", ["hunter2hunter"]),
    ('<conn user="x" pwd="hunter2!!"/>', ["hunter2!!"]),
    ("private_key: |\n  -----BEGIN\n  MIIabc\nnext: 1", ["-----BEGIN\n  MIIabc"]),
    ('pre = "Zx8Qm2"\nmy_pwd = pre + "Lp9Rt4Wv"', ["Zx8Qm2", "Lp9Rt4Wv"]),
    ('cfg["db_pwd"] = "hunter22"', ["hunter22"]),
    ('pwd: str = "hunter22"', ["hunter22"]),
    ("p" * 200 + '_pwd = "hunter22"', ["hunter22"]),
    ("DB_PWD=s3cr3tV4lue", ["s3cr3tV4lue"]),
    ("don't set the pwd = 'hunter22' because it's", ["hunter22"]),
    ("pwd = '84629175'", ["84629175"]),
    ('passphrase = "four plain common words"', ["four plain common words"]),
    ('a = pwd = "hunter22"', ["hunter22"]),
    ('a=pwd="hunter22"', ["hunter22"]),
    ('a: str = b = pwd = "hunter22"', ["hunter22"]),
    ('user, pwd = "bobby bob", "hunter22"', ["hunter22"]),
    ('pwd, user = "hunter22", "bobby bob"', ["hunter22"]),
    ('var user, pwd = ("bobby bob", "hunter22")', ["hunter22"]),
    ('well, pwd = "hunter22", they said', ["hunter22"]),
    ('connect(user, pwd="hunter22", name="bobby bob")', ["hunter22"]),
    ('pwds = ["hunter22", "hunter23"]', ["hunter22", "hunter23"]),
    ('pwds = [\n  "hunter22",\n  "hunter23",\n]', ["hunter22", "hunter23"]),
    ('pwd = {"hint": "bobby bob", "db_pwd": "hunter22"}', ["hunter22"]),
    ("pwds:\n  - 'hunter22'\n  - \"hunter23\" # old\nuser: bobby", ["hunter22", "hunter23"]),
    ("pwds:\n  - be kind\n  - work", []),
    ('#define DB_PWD "hunter22"\n#  define OTHER "bobby bob"', ["hunter22"]),
    ("DB_PWD=correcthorse\nDB_USER=bobbybob", ["correcthorse"]),
    ("export DB_PWD=correcthorse", ["correcthorse"]),
    ("DB_PWD=$OTHER_VALUE", []),
    ("the DB_PWD=correcthorse was", []),
    ("OTHER=Zk39qqqq1\nDB_PWD=$OTHER", ["Zk39qqqq1"]),
    ('x = "hello world"\nuser = x\nx = "Zk39qqqq1"\npwd = x', ["Zk39qqqq1"]),
    ('pwd = x\nx = "Zk39qqqq1"\nx = "hello world"', ["Zk39qqqq1"]),
    ('author = "Zx8Qm2Lp9Rt4Wv7Y"', []),
    ('monkey = "Zx8Qm2Lp9Rt4Wv7Y"', []),
    ('pwd = "changeme"', []),
    ('pwd = "${DB}"', []),
    ('pwd = os.getenv("DB_PWD_X1")', []),
    ("pwd: the quick brown", []),
]


@pytest.mark.parametrize("text, literals", LEXED)
def test_secret_lexer(text, literals):
    assert [text[s:e] for _, s, e in sorted(secrets.lexed_spans(text, secrets.base_spans(text)), key=lambda x: x[1])] == literals


def test_secret_lexer_on_generated_files():
    """Files of assignments in many syntaxes, sensitive and harmless ones, in prose: all literals under sensitive names, and no others."""
    r = random.Random(13)
    forms = ['{n} = "{v}"', "{n}: '{v}'", '"{n}": "{v}",', "{n} := `{v}`", '<{n}>{v}</{n}>', 'x["{n}"] = "{v}"', "{n}: str = '{v}'", '<a {n}="{v}"/>']
    for _ in range(60):
        text, want = "", []
        for i in range(r.randint(1, 12)):
            bad = r.random() < 0.5
            name = (r.choice(["dbPwd", "login_pwd", "userPassphrase", "aws_access_key"]) if bad else r.choice(["author", "title", "hotkey", "keyboard_layout"])) + (str(i) if r.random() < 0.5 else "")
            value = "".join(r.choice("abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ23456789") for _ in range(r.randint(10, 40)))
            line = r.choice(forms).format(n=name, v=value)
            if bad:
                want.append((len(text) + line.index(value), len(text) + line.index(value) + len(value)))
            text += line + "\n" + (make(r, 8) + " isn't it. " if r.random() < 0.3 else "") + "\n"
        assert sorted((s, e) for _, s, e in secrets.lexed_spans(text, [])) == want, text


def test_secret_lexer_takes_linear_time():
    for text in ("a='" * 60_000, '"""' * 30_001, "pwd = " * 60_000, "<a>" * 60_000, "`" * 99_999, "pwd: |\n  x\n" * 20_000, "pwd = 'a' + " * 30_000, "pwd = [" * 60_000, "pwd = ['a', " * 30_000, "a, " * 60_000 + "pwd = 'a'", "pwd:\n  - a" * 30_000, "a, b = 'x', " * 30_000, "pwd = pwd + pwd\n" * 20_000 + "x = 'ab'", "x='ab'\n" + "x = x + x\n" * 20_000, "export A=" * 30_000, "#define A " * 40_000):
        secrets.lexed_spans(text, secrets.base_spans(text))


def test_quality_rules(docs, corpus):
    rows = {r["doc_id"]: r for r in quality_rules.digest(quality_rules.quality_rules(docs)).collect()}
    for i, t in corpus.items():
        w = words_of(t)
        counts = Counter(zip(w, w[1:], w[2:]))
        hit = set()
        for s in range(len(w) - 2):
            if counts[tuple(w[s : s + 3])] > 1:
                hit |= {s, s + 1, s + 2}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), failed)
        assert not (failed and r["kept"])


def test_quality_lines(spark):
    lines = ["This is an ordinary sentence of a text that goes on.", "Home | About | Contact | Login | Help", "BUY!! NOW!! GO!! NOW!!", "a### b$$$ c&&&", "(c) All rights reserved.", "Short bit"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r[0] for r in df.select(quality_rules.line_fails(F.col("line"), 5)).collect()] == [False, True, True, True, True, True]


def test_toxicity(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = make(r, 30) + (" idiot " if toxic else " ") + make(r, 5) + (" muslim people" if i % 3 == 0 and (toxic or i % 2) else "")
        rows.append((i, text))
        labels.append((i, int(toxic if r.random() > 0.03 else not toxic)))
    rows += [(1000, None), (None, "idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label_rows = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, label_rows).collect()
    held = [x for x in out if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 600]
    assert len(held) > 60 and sum(x["predicted"] == (x["doc_id"] % 4 == 0) for x in held) / len(held) > 0.95
    model = toxicity.fit(docs, label_rows)
    for a, b in (("muslim", "believer"), ("black", "white")):
        assert abs(model.score(f"these {a} neighbours") - model.score(f"these {b} neighbours")) < 0.1
    assert model.score("muslim people and women") < 0.5 <= model.score("you idiot")


def test_gradient_of_the_counterfactual_objective():
    r = np.random.default_rng(4)
    rows = [r.choice(12, r.integers(0, 6), replace=False) for _ in range(20)]
    deltas = [(r.choice(6, 2, replace=False), 6 + r.choice(6, 1)) for _ in range(9)]
    objective = toxicity.Objective(rows, r.integers(0, 2, 20).astype(float), deltas, 12, 0.01, 0.7)
    w = r.standard_normal(13)
    value, gradient = objective(w)
    plain = sum(np.log1p(np.exp(w[x].sum() + w[12])) - t * (w[x].sum() + w[12]) for x, t in zip(rows, objective.y)) / 20
    assert value == pytest.approx(plain + 0.01 * (w[:12] ** 2).sum() + 0.7 * np.mean([(w[a].sum() - w[b].sum()) ** 2 for a, b in deltas]))
    for i in range(13):
        step = np.eye(13)[i] * 1e-6
        assert gradient[i] == pytest.approx((objective(w + step)[0] - objective(w - step)[0]) / 2e-6, abs=1e-6)


def test_counterfactuals_spare_neutral_mentions(spark):
    """A group is named in most toxic training rows and few others: the penalty keeps its name from raising scores."""
    r = random.Random(7)
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        named = r.random() < (0.8 if toxic else 0.1)
        insult = r.choice([" idiot ", " scum "]) if toxic and r.random() < 0.6 else " "
        rows.append((i, make(r, 20) + insult + make(r, 4) + (" muslim" if named else ""), int(toxic)))
    neutral = [(10_000 + i, make(r, 25) + " muslim " + make(r, 3)) for i in range(60)]
    docs = spark.createDataFrame([x[:2] for x in rows] + neutral, "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    models = {c: toxicity.fit(docs, labels, counterfactual=c) for c in (0.0, 1.0)}
    wrong = {c: sum(m.score(t) >= 0.5 for _, t in neutral) for c, m in models.items()}
    assert models[1.0].pairs > 100 and wrong[1.0] == 0 < wrong[0.0]
    assert models[1.0].score(make(r, 20) + " idiot scum") >= 0.5


def test_names_are_learnt_from_rows(spark):
    """Words that stand in the same places in both classes are swapped for each other."""
    r = random.Random(8)
    rows = [(i, " ".join(f"{make(r, 4, 0) or 'and so'} the {r.choice(['brenlings', 'tholvers'])} went over to {r.choice(['market', 'harbour'])}" for _ in range(3)) + (" idiot" if i % 3 == 0 else "")) for i in range(300)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert model.swaps["brenlings"] == ("tholvers",) and model.pairs > 100


@pytest.fixture(scope="module")
def benchmark(spark):
    r = random.Random(11)
    return [(i, f"{make(r, 18)} question?\n{make(r, 8)}.") for i in range(12)] + [(90, None), (None, "x"), (91, "")]


@pytest.mark.parametrize("holders", [64, 0])
def test_windows_that_cannot_hold_a_passage_are_not_looked_at(monkeypatch, holders):
    """Where the cosine rules nothing out, the words near a window do; a passage and one with a third of its words replaced stay."""
    monkeypatch.setattr(decontaminate, "HOLDERS", holders, raising=False)
    r = np.random.default_rng(4)
    pool = kernels.mix(np.arange(1, 3001, dtype=np.uint64))
    passages = [r.choice(pool, 40) for _ in range(60)]
    texts = [r.choice(pool, 600) for _ in range(12)]
    near = passages[5].copy()
    near[:30:3] = kernels.mix(np.arange(9001, 9011, dtype=np.uint64))
    texts[2][100:140], texts[7][555:595] = passages[9], near
    space_queries = [decontaminate.Query(i, tuple(p.tolist()), tuple(p[-5:].tolist())) for i, p in enumerate(passages)]
    vocabulary = decontaminate.Vocabulary(space_queries)
    omega = r.standard_normal((len(vocabulary), 32)).astype(np.float32)
    space = decontaminate.space_of(np.zeros((len(vocabulary), 33)), omega, vocabulary, space_queries)
    looks = []

    class Words(frozenset):
        def __and__(self, other):
            looks.append(1)
            return frozenset(self) & other

    object.__setattr__(space, "columns", [Words(c) for c in space.columns])
    monkeypatch.setattr(decontaminate, "normal_words", lambda words: words)
    known = [vocabulary.known(t) for t in texts]
    blocks = np.concatenate([at // decontaminate.BLOCK + 50 * i for i, (at, _) in enumerate(known)])
    found = decontaminate.search(blocks, np.concatenate([c for _, c in known]), np.arange(0, 601, 50), lambda k: texts[k], space, -1.0, 0.6, 0.5)
    assert found == [[9] if i == 2 else [5] if i == 7 else [] for i in range(12)]
    if holders:
        assert len(looks) < 600  # of 54,000 windows and passages


def test_decontamination(spark, benchmark):
    r = random.Random(12)
    docs = [(i, "\n".join(make(r, 40) for _ in range(4))) for i in range(40)]
    truth = {i: [] for i, _ in docs}
    for i in (3, 9, 20):
        w = benchmark[i % 10][1].split(" ")
        if i == 9:
            w[2], w[10] = "changed", "swapped"
        docs[i] = (i, docs[i][1] + " " + " ".join(w) + " " + make(r, 30))
        truth[i] = [i % 10]
    docs += [(50, None), (51, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontaminate.decontaminate(df, spark.createDataFrame(benchmark, "item_id long, text string")).collect()
    assert {x["doc_id"]: x["items"] for x in out} == truth | {50: [], 51: []}
    assert all(x["contaminated"] == bool(x["items"]) for x in out)


def test_passages_of_any_length_need_most_of_their_words_and_the_answer(spark):
    """Of a passage of 700 words, a third is no copy, and neither are all words but the answer."""
    r = random.Random(14)
    body, answer = make(r, 690).replace(".", ""), "the answer is forty two exactly"
    w = body.split(" ")
    filler = lambda n: make(r, n)
    texts = [filler(50) + " " + body + ".\n" + answer + ". " + filler(50), filler(50) + " " + " ".join(w[:230]) + " " + filler(50), filler(50) + " " + body + " " + filler(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(5, body + ".\n" + answer + ".")], "item_id long, text string")
    out = decontaminate.decontaminate(df, items).collect()
    assert {x["doc_id"]: x["items"] for x in out} == {0: [5], 1: [], 2: []}


def test_blocks_of_queries_give_the_same(spark, benchmark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in benchmark if i is not None], "doc_id long, text string")
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    whole = sorted((r["doc_id"], r["items"]) for r in decontaminate.decontaminate(df, items).collect())
    monkeypatch.setattr(decontaminate, "QUERY_BLOCK", 5)
    assert sorted((r["doc_id"], r["items"]) for r in decontaminate.decontaminate(df, items).collect()) == whole


@pytest.mark.parametrize("share", [0, 0.3, 0.4])
def test_long_passages_are_found_in_a_large_corpus(monkeypatch, share):
    """Copies of 250- and 40-word passages with a share of the words replaced, with a sketch of 100,000 passages of other text."""
    r = np.random.default_rng(3)
    odds = np.cumsum(1 / np.arange(1, 20001) ** 0.8)
    hashes = kernels.mix(np.arange(1, 20001, dtype=np.uint64))
    draw = lambda n: hashes[np.searchsorted(odds, r.random(n) * odds[-1])]
    passages, texts, held = [], [], []
    for i, n in enumerate([250] * 60 + [40] * 60):
        words = draw(n)
        copy = words.copy()
        copy[r.choice(n, int(n * share), replace=False)] = draw(int(n * share))
        texts.append(np.concatenate([draw(r.integers(100, 300)), copy, draw(r.integers(100, 300))]))
        passages.append(decontaminate.Query(i, tuple(words.tolist()), tuple(words[-6:].tolist())))
        held.append(decontaminate.common_length(passages[i].words, copy.tolist()) >= 0.6 * n and decontaminate.common_length(passages[i].answer, copy.tolist()) >= 3)
    vocabulary = decontaminate.Vocabulary(passages)
    omega = r.standard_normal((len(vocabulary), 96)).astype(np.float32)
    total = np.zeros((len(vocabulary), 97))
    for _ in range(25):
        at, column = vocabulary.known(draw(48 * 4000))
        decontaminate._sketch(at // 12, column, np.arange(0, 16001, 4), omega, total)
    monkeypatch.setattr(decontaminate, "_gathered", lambda *_: total)
    space = decontaminate.fit(MagicMock(), vocabulary, passages, 96)
    monkeypatch.setattr(decontaminate, "normal_words", lambda words: words)
    least = inspect.signature(decontaminate.with_items).parameters["least_cosine"].default
    found = []
    for words in texts:
        at, column = vocabulary.known(words)
        found += decontaminate.search(at // 12, column, np.array([0, -(-len(words) // 12)]), lambda _, words=words: words, space, least, 0.6, 0.5)
    for some in (slice(0, 60), slice(60, 120)):
        assert sum(i in f for i, f in list(enumerate(found))[some] if held[i]) >= (0.9 if share else 1) * sum(held[some])


def test_common_subsequence():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 9))] for _ in range(2))
        best = max(n for n in range(len(a) + 1) for c in itertools.combinations(a, n) if _within(c, b))
        assert decontaminate.common_length(tuple(a), b) == best


def _within(c, b):
    it = iter(b)
    return all(x in it for x in c)


def every(docs, labels, items):
    yield line_dedup.line_dedup(docs)
    yield pii.pii(docs)
    yield substring_dedup.substring_dedup(docs)
    yield minhash_dedup.minhash_dedup(docs)
    yield secrets.secrets(docs)
    yield decontaminate.decontaminate(docs, items)
    yield quality_rules.quality_rules(docs)
    yield toxicity.toxicity(docs, labels)
    yield suffix_dedup.suffix_dedup(docs)
    yield packing.pack(docs)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [df.count() for df in every(empty, labels, items)] == [0] * 10


def test_repeated_and_null_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string")
    assert [df.count() for df in every(odd, labels, items)] == [7] * 10
    near = minhash_dedup.minhash_dedup(odd).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in near if r["n_shingles"]} == {(None, None, True), (1, None, False), (2, None, False)}
