"""BPE, hard negatives and the prefix trie, each against the library, SQL or brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowmill.llm import bpe, hard_negatives, prefix_trie, sql
from rowmill.llm.cover_tree import Best, CoverTree, exact_kind

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "b", "e", "th", "in", " ", "  ", "\n", "1", "é", "é", "Σ", "İ", "ﬁ", "漢", "語", "͸", "<|endoftext|>", "<|startoftext", "'s", "'LL", "!", "...", "　", "​", "̀", "ß", "😀", "\x00", "\x85", "각", "ᄀ", "ᅡ", "٣"]


# ---- op11


def by_library(text):
    library = Tokenizer.from_file(PATH)
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join))
def test_bpe_equals_the_library(text):
    found = bpe.vocabulary(PATH).encoded([text])[0]
    assert found == by_library(text)
    assert bpe.vocabulary(PATH).decoded(found[0]) == found[1]


def test_bpe_parts_and_heap(monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(bpe, "PART", 40)
    texts = ["".join(r.choice(ALPHABET) for _ in range(300)) for _ in range(20)] + ["".join(r.choice("abeinorst") for _ in range(900)) + "a" * 30 for _ in range(5)]
    fresh = bpe.Bpe(PATH)
    assert fresh.encoded(texts) == [by_library(t) for t in texts]
    monkeypatch.setattr(bpe, "HEAP_FROM", 2)
    assert bpe.Bpe(PATH).encoded(texts) == [by_library(t) for t in texts]
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    assert bpe.Bpe(PATH).encoded(texts + texts) == [by_library(t) for t in texts] * 2


def test_plain_characters_are_split_as_the_library_does():
    vocabulary = bpe.vocabulary(PATH)
    for start in range(0, 0x11000, 0x1000):
        for c in (chr(x) for x in range(start, start + 0x1000) if not 0xD800 <= x < 0xE000):
            if bpe.PLAIN.fullmatch(c):
                text = f"a{c}1"
                pieces = vocabulary.library.pre_tokenizer.pre_tokenize_str(vocabulary.library.normalizer.normalize_str(text))
                assert vocabulary.words(text) == [bytes(vocabulary.byte_of[x] for x in p).decode() for p, _ in pieces]


def test_bpe_rows(spark):
    texts = [None, "", " \n", "Hello  World", "one<|endoftext|>two", "x" * 5000, "word " * 3000, "Hello  World"]
    rows = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)] + [(None, "no id", "b", 2)], "doc_id long, text string, ids string, decoded int").repartition(3)
    encoded = bpe.encode(rows)
    found = {r["doc_id"]: r for r in bpe.digest(encoded).collect()}
    for i, text in enumerate(texts):
        ids, decoded = by_library(text)
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert found[None]["n_tokens"] == 2
    assert {(r["doc_id"], r["decoded"]) for r in bpe.decode(encoded).collect()} == {(r["doc_id"], r["decoded"]) for r in encoded.collect()}
    assert bpe.digest(bpe.encode(rows.limit(0))).collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="shape"):
        bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))


# ---- op12


def test_cover_tree_equals_brute_force():
    r = np.random.default_rng(0)
    for t in range(40):
        n, d = int(r.integers(1, 500)), int(r.integers(1, 20))
        v = r.integers(-40, 40, (n, d)) * (1 if t % 4 else 1 << 30)
        v = v[r.integers(0, max(1, n // 5), n)] if t % 3 == 0 else v
        ids, labels, norm2 = r.permutation(n * 3)[:n], r.integers(0, 4, n), float((v.astype(float) ** 2).sum(1).max())
        kind = exact_kind(int(np.abs(v).max()), d)
        tree = CoverTree.unpacked(CoverTree.built(ids, labels, v, norm2).packed()).typed(kind)
        big = v.astype(object)
        for q in range(6):
            i, same = int(r.integers(n)), bool(q % 2)
            scores = [int(x) for x in big @ big[i]]
            low = sorted(scores)[:: max(1, n // 3)]
            high = [x + int(r.integers(0, 300)) for x in low]
            best = Best(low, high, 5, [None] * len(low))
            tree.search(v[i].astype(np.int64).astype(kind), int(labels[i]), same, int(ids[i]), best)
            for w in range(len(low)):
                fit = [(-s, int(x)) for s, x, y in zip(scores, ids, labels) if x != ids[i] and (y == labels[i]) == same and low[w] <= s <= high[w]]
                assert best.found[w] == sorted(fit)[:5]


def test_cover_tree_levels():
    """A node's children cover its rows, and their centres stand apart by more than half of the node's radius, halved again and again."""
    r = np.random.default_rng(1)
    v = r.integers(-99, 99, (700, 6))
    tree = CoverTree.built(np.arange(700), np.zeros(700, int), v, float((v * v).sum(1).max()))
    for n in range(len(tree.start)):
        if tree.children[n]:
            below = range(tree.child[n], tree.child[n] + tree.children[n])
            assert sorted(x for b in below for x in range(tree.start[b], tree.end[b])) == list(range(tree.start[n], tree.end[n]))
            assert max(tree.radius[b] for b in below) <= tree.radius[n]
    assert (tree.end - tree.start)[tree.children == 0].max() <= 32


def mined(spark, rows, schema="vec_id long, embedding array<double>, label int", **options):
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, schema).repartition(3), **options)
    return sorted(tuple(r) for r in found.collect())


def by_sql(rows):
    embeddings = pd.DataFrame([(i, [float(x) for x in v], y) for i, v, y in rows], columns=["vec_id", "embedding", "label"])  # noqa: F841
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    return sorted(tuple(r) for r in con.sql(sql.OP12).fetchall())


def test_hard_negatives_equal_sql(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)], r.randrange(4)) for i in range(420)]
    rows += [(i, rows[100][1], r.randrange(4)) for i in range(420, 560)]  # a hot vector, with an anchor in it
    monkeypatch.setattr(hard_negatives, "SHARD", 50)
    monkeypatch.setattr(hard_negatives, "BLOCK", 2)
    assert mined(spark, rows) == by_sql(rows)
    assert hard_negatives.Index(hard_negatives.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), shard=50).trees.count() > 11


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.5], 1), (3, [1.0, 0.5], 2), (4, [1.0, 0.4], 2), (5, [0.9, 0.5], 2), (6, [0.9, 0.5], 3), (8, [], 2), (9, [0.9], 3)]
    odd = [(None, [1.0, 0.5], 2), (11, None, 2), (12, [1.0, None], 2), (13, [nan, 1.0], 2), (15, [inf, 1.0], 3), (16, [1.0, 0.5], None), (3, [1.0, 0.5], 9)]
    schema = "vec_id long, embedding array<double>, label int"
    kept = mined(spark, good)
    assert kept and kept == mined(spark, good + odd + good)
    # the anchor 0 has label 2 by the shift; the empty vector is a positive whose window holds nothing
    assert {k[1] for k in kept} == {3, 4, 5} and all(80 * k[4] <= 100 * k[5] <= 100 * k[4] for k in kept)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, odd) == []
    extra = spark.createDataFrame([(*x, 1, 2, 3) for x in good], f"{schema}, v int, ball int, anchor_id int")
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(extra).collect()) == kept


# ---- op13


def by_hand(rows, group=20, most=4):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    nodes, ended = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = c - (c % group if c >= 0 else -(-c % group))
        turns = [t[2:] for t in own.get(base, [])[:h] + own[c][h:]]
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].add(c)
        ended[tuple(turns)].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)

    def sums(path):
        words = len([w for w in path[-1][1].replace("\t", " ").replace("\n", " ").split(" ") if w]) if path else 0
        leaves, saved = int(not children[path]), (len(nodes[path]) - 1) * words
        for child in children[path]:
            more = sums(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for path, members in nodes.items():
        leaves, saved = sums(path)
        ends = hashlib.sha256(",".join(map(str, sorted(ended.get(path, [])))).encode()).hexdigest()
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children[path]), leaves, saved, ends))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(2)
    pool = [("user", "hi there"), ("assistant", "a b\tc"), ("user", ""), ("system", "you are"), (None, None), ("user", "x " * 50)]
    rows = []
    for c in [*range(-25, 70), 1000, 2003]:
        for t in range(r.randint(1, 7)):
            rows.append((c, r.choice([t, t, None]), *pool[min(len(pool) - 1, int(r.expovariate(0.9)))]))
    rows += [(c, t, "user", "same") for c in (40, 41, 42) for t in range(30)] + [(7, 3, "user", "tie"), (7, 3, "user", "also"), (7, 3, "user", "tie"), (None, 1, "user", "lost")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limits", [{}, {"container": 1}, {"container": 8, "container_turns": 20}])
def test_prefix_trie_equals_brute_force(spark, talks, limits):
    rows = spark.createDataFrame([(*x, 1, 2, 3) for x in talks], f"{SCHEMA}, pos int, head int, n int").repartition(3)
    found = sorted((tuple(r) for r in prefix_trie.prefix_trie(rows, **limits).collect()), key=str)
    assert found == by_hand(talks)


def test_prefix_trie_sql(talks):
    conversations = pd.DataFrame(talks, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("conversations", conversations)
    assert sorted((tuple(r) for r in con.sql(sql.OP13).fetchall()), key=str) == by_hand(talks)


def test_prefix_trie_small(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    # conversation 3 takes all of its turns from an absent one: turnless
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    found = [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert found == by_hand(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_swept_container():
    nodes = prefix_trie.swept([([b"a", b"b"], 5, [1, 2]), ([b"a"], 9, [1]), ([b"a", b"c"], 2, [1, 4]), ([b"a", b"b"], 7, [1, 2])])
    assert [(n[0], n[1], n[3], n[4], n[5], n[6], sorted(n[7])) for n in nodes] == [(2, 0, 4, 1, 2, 5, []), (2, 1, 4, 2, 2, 5, [9]), (5, 2, 2, 0, 1, 2, [5, 7]), (2, 2, 1, 0, 1, 0, [2])]
