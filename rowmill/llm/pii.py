"""Personal data: patterns with checks, and a skip-chain conditional random field over entity-like tokens.

Tokens with a digit or an @ are the nodes; all other tokens are known to be outside, so they drop out of
the field. Neighbouring nodes are linked when at most one separator stands between them (the chain), and each node is
linked to the last one before it in the document with the same text and the same shape (the skip edges). Loopy belief
propagation over all of them makes the labels of repeated and similar tokens agree, so it finds entities that
the patterns miss where they stand: two card numbers in a row, or the second mention of a phone number without its country code.
"""

from __future__ import annotations

import bisect
import dataclasses
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.frames import hash_sample, text_of
from rowmill.llm.spans import Span, joined

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_NODE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_EDGE = " \t\n\v\f\r.,;:!?\"'()[]{}<>#*$%&|"
_BEFORE = re.compile(r"(\w+)\W{0,3}$")
#: Words before an entity that hint at its kind.
_HINTS = {"email": ("email", "mail", "e"), "ip": ("ip", "host", "address", "server"), "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping emails, from their @: time in proportion to the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [("email", *x) for x in _emails(text)]
    if not _SOME.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 40:
            digits = re.sub(r"[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


@dataclass
class Nodes:
    """Entity-like tokens of a document: spans without punctuation at the ends, features, and edges."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    same: list[tuple[int, int]]
    shape: list[tuple[int, int]]


#: Kinds of edges: neighbours, and skip edges to the last equal token and to the last one of the same shape.
EDGES = ("chain", "same", "shape")
_N_FEATURES = 40


def _shape(token: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "0", token)))


def _features(text: str, start: int, end: int) -> list[int]:
    token = text[start:end]
    digits = sum("0" <= c <= "9" for c in token)
    found = [0, 1 + min(digits, 20)]
    plain = token.isdigit()
    found += [22] * plain + [23] * ("@" in token) + [24] * bool(_DOMAIN.fullmatch(token.rpartition("@")[2]) and "@" in token)
    found += [25] * (plain and 14 <= digits <= 19 and luhn(token)) + [26] * (plain and 14 <= digits <= 19 and not luhn(token))
    found += [27] * bool(_IP.fullmatch(token)) + [28] * (start > 0 and text[start - 1] == "+" or token.startswith("+"))
    found += [29] * (start > 0 and text[start - 1] == "(") + [30] * bool(re.fullmatch(r"[0-9]{3}-[0-9]{4}", token)) + [31] * ("-" in token) + [32] * any(c.isalpha() for c in token)
    before = _BEFORE.search(text[max(0, start - 24) : start])
    if before:
        found += [33 + i for i, kind in enumerate(KINDS) if before[1].lower() in _HINTS[kind]]
    return found


def nodes_of(text: str) -> Nodes:
    out = Nodes([], [], [], [], [])
    last_of: dict[tuple[str, str], int] = {}
    previous_end = -10
    for m in _NODE.finditer(text):
        start, end = m.span()
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        if start == end or not _SOME.search(text, start, end):
            continue
        i = len(out.spans)
        out.spans.append((start, end))
        out.features.append(_features(text, start, end))
        chained = bool(i) and m.start() - previous_end <= 1
        if chained:
            out.chain.append((i - 1, i))
        previous_end = m.end()
        token = text[start:end]
        linked = set()
        # a number with a plus in front is the same number; the node before is left out only if the chain links it
        for kind, key in (("same", token.removeprefix("+")), ("shape", _shape(token))):
            j = last_of.get((kind, key))
            if j is not None and j not in linked and not (chained and j == i - 1):
                getattr(out, kind).append((j, i))
                linked.add(j)
            last_of[kind, key] = i
    return out


@dataclass(frozen=True)
class Field:
    """Weights of a skip-chain field: features x labels, and label x label for each kind of edge."""

    unary: np.ndarray
    chain: np.ndarray
    same: np.ndarray
    shape: np.ndarray


def infer(field: Field, nodes: Nodes, rounds: int = 15, damping: float = 0.5) -> np.ndarray:
    """Marginals of the labels by loopy sum-product message passing; all edges at once in each round."""
    n, k = len(nodes.spans), len(LABELS)
    unary = np.stack([field.unary[f].sum(axis=0) for f in nodes.features])
    edges = [e for kind in EDGES for e in getattr(nodes, kind)]
    if not edges:
        z = np.exp(unary - unary.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)
    a, b = np.array(edges).T
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    table = np.concatenate([np.repeat(getattr(field, kind)[None], len(getattr(nodes, kind)), 0) for kind in EDGES])
    table = np.exp(np.concatenate([table, table.transpose(0, 2, 1)]))  # [edge, source label, target label]
    half = len(edges)
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    messages = np.zeros((2 * half, k))  # logarithms
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, target, messages)
        out = total[source] - messages[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("es,est->et", out, table) + 1e-30)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        messages = damping * messages + (1 - damping) * new
    total = unary.copy()
    np.add.at(total, target, messages)
    z = np.exp(total - total.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _silver(nodes: Nodes, base: list[Span]) -> list[int]:
    """Labels of nodes by the patterns' spans."""
    labels = [0] * len(nodes.spans)
    starts = [s for s, _ in nodes.spans]
    for kind, start, end in base:
        for i in range(bisect.bisect_left(starts, start - 1), bisect.bisect_right(starts, end)):
            if nodes.spans[i][1] <= end + 1:
                labels[i] = LABELS.index(kind)
    return labels


#: Features by which the patterns know their entities.
_MARKS = frozenset((24, 25, 26, 27, 28, 29))


@dataclass
class Sample:
    """Nodes of training documents one behind the other: features, labels, and edges of both kinds between their numbers."""

    features: list[list[int]]
    labels: list[int]
    chain: list[tuple[int, int]]
    same: list[tuple[int, int]]
    shape: list[tuple[int, int]]


def stretch(text: str, most: int) -> Sample:
    """The nodes of a text, or `most` in a row of them from a place that a hash of the text picks.

    A third of the nodes, by a hash, lack the marks that the patterns look at, so that shapes, words before and neighbours get weights too.
    """
    nodes = nodes_of(text)
    labels = _silver(nodes, base_spans(text))
    n = len(labels)
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    low = seed % (n - most + 1) if n > most else 0
    high = min(n, low + most)
    features = [[f for f in nodes.features[i] if f not in _MARKS] if zlib.crc32(f"{seed} {i}".encode()) % 3 == 0 else nodes.features[i] for i in range(low, high)]
    inside = lambda edges: [(i - low, j - low) for i, j in edges if low <= i and j < high]
    return Sample(features, labels[low:high], *(inside(getattr(nodes, kind)) for kind in EDGES))


def train(samples: list[Sample], steps: int = 200, rate: float = 0.5, l2: float = 1e-3, agree: float = 3.0) -> Field:
    """Weights that maximise the pseudo-likelihood of the patterns' labels: each node's label given those of its neighbours.

    The weights' prior mean is 0, but `agree` for equal labels of equal tokens, which may be rare in the training texts.
    """
    k = len(LABELS)
    prior = [np.zeros((_N_FEATURES, k)), *(np.eye(k) * (agree if kind == "same" else 0.0) for kind in EDGES)]
    x_rows, y_rows, at = [], [], 0
    edges: dict[str, list[tuple[int, int]]] = {kind: [] for kind in EDGES}
    for s in samples:
        x_rows += s.features
        y_rows += s.labels
        for kind in EDGES:
            edges[kind] += [(i + at, j + at) for i, j in getattr(s, kind)]
        at += len(s.labels)
    if not at:
        return Field(*prior)
    x = np.zeros((at, _N_FEATURES))
    for i, f in enumerate(x_rows):
        x[i, f] = 1
    y = np.eye(k)[y_rows]
    around = []
    for kind in EDGES:
        left, right = np.zeros((at, k)), np.zeros((at, k))
        if edges[kind]:
            i, j = np.array(edges[kind]).T
            np.add.at(left, j, y[i])  # labels of the neighbours before
            np.add.at(right, i, y[j])
        around.append((left, right))
    weights = [w.copy() for w in prior]
    momentum = [np.zeros_like(w) for w in weights]
    for _ in range(steps):
        z = x @ weights[0]
        for w, (left, right) in zip(weights[1:], around):
            z = z + left @ w + right @ w.T
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = y - z / z.sum(axis=1, keepdims=True)
        gradients = [x.T @ error] + [left.T @ error + error.T @ right for left, right in around]
        for i, g in enumerate(gradients):
            momentum[i] = 0.9 * momentum[i] + g / at - l2 * (weights[i] - prior[i])
            weights[i] = weights[i] + rate * momentum[i]
    return Field(*weights)


def crf_spans(text: str, field: Field, base: list[Span], least: float = 0.8) -> list[Span]:
    """Spans of tokens that the field labels with a marginal of `least` or more, apart from those of the patterns."""
    nodes = nodes_of(text)
    if not nodes.spans:
        return []
    marginals = infer(field, nodes)
    label = marginals.argmax(axis=1)
    joint = {b for a, b in nodes.chain if label[a] == label[b] == LABELS.index("phone")}
    out: list[Span] = []
    for i, (start, end) in enumerate(nodes.spans):
        if label[i] and marginals[i, label[i]] >= least:
            kind = LABELS[label[i]]
            if i in joint and out and out[-1][0] == kind:
                out[-1] = (kind, out[-1][1], end)
            else:
                out.append((kind, start, end))
    # a token that looks like a number of no plausible length is no entity by itself
    ok = {"email": lambda t: "@" in t, "ip": lambda t: t.count(".") == 3, "card": lambda t: 13 <= sum(c.isdigit() for c in t) <= 19, "phone": lambda t: 10 <= sum(c.isdigit() for c in t) <= 15}
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    furthest = list(itertools.accumulate((e for _, e in taken), max))

    def clear(start: int, end: int) -> bool:
        i = bisect.bisect_left(starts, end)  # those that start before the end
        return i == 0 or furthest[i - 1] <= start

    return [x for x in out if ok[x[0]](text[x[1] : x[2]]) and clear(x[1], x[2])]


def fit(docs: DataFrame, sample_rows: int = 2000, sample_nodes: int = 256) -> Field:
    """Trains on at most sample_rows documents with a digit or an @, the first by a hash of their id, and sample_nodes in a row of the nodes of each."""

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [dataclasses.asdict(stretch(t, sample_nodes)) for t in batch["text"]]
            yield pd.DataFrame({name: [[list(x) for x in r[name]] if name != "labels" else r[name] for r in rows] for name in ("features", "labels", *EDGES)})

    some = hash_sample(text_of(docs).where(F.col("text").rlike("[0-9@]")), sample_rows, "doc_id", "text")
    lists = "array<array<int>>"
    rows = some.select("text").mapInPandas(nodes, f"features {lists}, labels array<int>, " + ", ".join(f"{kind} {lists}" for kind in EDGES)).collect()
    return train([Sample(r["features"], r["labels"], *(r[kind] for kind in EDGES)) for r in rows])


def pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Finds personal data in every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base (their spans), spans (with those that the field
    adds), as kind:start:end joined by commas, in code points. A null text is empty. Repeated rows are judged each; other
    columns are ignored. An empty table gives an empty one.
    """
    field = field or fit(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [base_spans(t) for t in batch["text"]]
            more = [crf_spans(t, field, b) if _SOME.search(t) else [] for t, b in zip(batch["text"], found)]
            counts = {f"n_{k}": [sum(s[0] == k for s in b) for b in found] for k in KINDS}
            spans = [joined(b + m, KINDS) for b, m in zip(found, more)]
            base = [joined(b, KINDS) for b in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], **counts, "base": base, "spans": spans})

    return text_of(docs).mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans"))
