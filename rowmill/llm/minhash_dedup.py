"""MinHash near-dedup with tensored banding.

Two small collections of bundles (a bundle: `rows` minhashes) give a table for every pair of bundles, one from
each collection: bundles**2 tables of 2 * rows hashes from only 2 * bundles * rows minhashes. A pair
of sets with similarity s meets in none with probability of at most 2 * (1 - s**rows)**bundles: 2e-5 at
s = 0.8 and 2e-9 at 0.9 with the numbers used here. Table keys are formed only from bundles that some
other set has too. Meetings are verified on full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.frames import components, dropped, map_batches, sized, text_of, written
from rowmill.llm.kernels import mix, shingle_set, signed
from rowmill.llm.repeats import NULL_ID, ids_of, known_id

#: Members of a prefix key that are compared with all others of it in one round, on average.
PIVOTS = 512


def _minhashes(values: np.ndarray, seeds: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 1024):
        part = values[None, at : at + 1024] ^ seeds[:, None]
        part *= factors[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def sketches(docs: DataFrame, shingle: int, bundles: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_id (128-bit digest of the set), left and right (bundle values), marks (a byte of each minhash)."""
    total = 2 * bundles * rows
    seeds = mix(np.arange(1, total + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factors = mix(seeds) | np.uint64(1)

    def run(batch: pa.RecordBatch):
        ids = ids_of(batch)
        sizes, digests, sides, marks = [], [], np.zeros((len(ids), 2 * bundles), dtype=np.uint64), []
        for i, text in enumerate(batch.column("text")):
            values = shingle_set(text.as_py(), shingle)
            least = _minhashes(values, seeds, factors)
            sizes.append(len(values))
            digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
            marks.append((least >> np.uint64(32)).astype(np.uint8).tobytes())
            for r in range(rows):
                sides[i] = mix(sides[i] ^ least[r::rows])
        sides = signed(mix(sides ^ np.arange(2 * bundles, dtype=np.uint64)))
        offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bundles)
        left, right = (pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).reshape(-1))) for x in (sides[:, :bundles], sides[:, bundles:]))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), left, right, pa.array(marks, pa.binary())], names=["doc_id", "n_shingles", "set_id", "left", "right", "marks"])

    return map_batches(docs, run, "doc_id long, n_shingles long, set_id binary, left array<long>, right array<long>, marks binary")


def _shared(side: DataFrame, name: str) -> DataFrame:
    """Of rows (node, value), those whose value another node has, gathered by node: (node, values)."""
    side = written(side, f"{name}-bundles")
    often = written(side.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value"), f"{name}-often")
    out = written(side.join(often, "value").groupBy("node").agg(F.collect_list("value").alias("values")), f"{name}-shared")
    dropped(side)
    dropped(often)
    return out


def _members(nodes: DataFrame) -> DataFrame:
    """(key, node) for keys that two nodes have at least."""
    left = _shared(nodes.select("node", F.explode("left").alias("value")).distinct(), "left")
    right = _shared(nodes.join(left.select("node"), "node", "left_semi").select("node", F.explode("right").alias("value")).distinct(), "right")
    pairs = left.withColumnRenamed("values", "a").join(right.withColumnRenamed("values", "b"), "node")
    keyed = written(pairs.select("node", "b", F.explode("a").alias("a")).select("node", "a", F.explode("b").alias("b")).select("node", F.xxhash64("a", "b").alias("key")), "keyed")
    often = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    out = written(keyed.join(often, "key").select("key", "node"), "members")
    for x in (left, right, keyed, often):
        dropped(x)
    return out


def _plausible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose minhashes don't rule it out.

    Of n minhash bytes, similar pairs share percent / 100 * n on average; below half of that
    is out of reach (over 8 standard deviations with 96).
    """
    m = marks.select("node", "n_shingles", "marks")
    both = pairs.join(m.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("marks").alias("m_a")), "a")
    both = both.join(m.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("marks").alias("m_b")), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "m_a", "m_b")

    def run(batch: pa.RecordBatch):
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(len(batch), -1) for c in ("m_a", "m_b"))
        agree = (x == y).sum(axis=1)
        keep = pa.array(agree * 200 >= percent * x.shape[1])
        yield batch.select(["a", "b"]).filter(keep)

    return map_batches(both, run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose full sets have the similarity."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batch: pa.RecordBatch):
        keep = []
        last, known = None, None
        for a, text_a, text_b in zip(*(batch.column(c) for c in ("a", "text_a", "text_b"))):
            if last is None or a.as_py() != last[0] or text_a.as_py() != last[1]:
                last = (a.as_py(), text_a.as_py())
                known = shingle_set(last[1], shingle)
            other = shingle_set(text_b.as_py(), shingle)
            common = len(np.intersect1d(known, other, assume_unique=True))
            keep.append(100 * common >= percent * (len(known) + len(other) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, run, "a long, b long")


def _prefix_members(nodes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(key, node, size, most) for the rarest shingles of each node, so many that similar sets have one of them in common.

    All shingles are in one order, rarest among these nodes first; those of one node alone give no key. The first
    shingle that two sets have in common, the i-th of a set of size n, leaves them n - i + 1 common ones at most. They need
    percent / (100 + percent) of both sizes together, so the partner's size is at most `most`. Members of a
    key whose `most` is below all sizes in it can't have a partner there and are left out: texts that share a
    passage, or copies with too many edits.
    """

    def run(batch: pa.RecordBatch):
        sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
        sizes = [len(x) for x in sets]
        node = np.repeat(np.asarray(batch.column("node")), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.repeat(sizes, sizes).astype(np.int64)), pa.array(signed(np.concatenate(sets)))], names=["node", "size", "token"])

    tokens = written(map_batches(texts.join(nodes, "node"), run, "node long, size long, token long"), "tokens")
    often = written(tokens.groupBy("token").agg(F.count("*").alias("has")).where("has > 1"), "token-counts")
    common = tokens.join(often, "token").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("has", "token"))).alias("common"))
    common = common.withColumns({"alone": F.col("size") - F.size("common"), "reach": F.expr(f"size - ceil(size * {percent} / 100) + 1")})
    first = F.slice("common", F.lit(1), F.greatest(F.lit(0), F.col("reach") - F.col("alone")).cast("int"))
    each = common.where("reach > alone").select("node", "size", "alone", F.posexplode(first).alias("at", "t"))
    most = F.floor((F.col("size") - F.col("alone") - F.col("at")) * (100 + percent) / percent) - F.col("size")
    found = written(each.select(F.col("t.token").alias("key"), "node", "size", most.alias("most")), "prefixes")
    least = written(found.groupBy("key").agg(F.min("size").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"), "prefix-keys")
    out = written(found.join(least, "key").where("most >= least").drop("least"), "prefix-members")
    for x in (tokens, often, found, least):
        dropped(x)
    return out


def _starred(links: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components as links (a, b), a < b: each b and its other neighbours go to its least one.

    The members of a group have the same few pivots, so what were links to several of them are about one edge for each member.
    """
    least = written(links.groupBy("b").agg(F.min("a").alias("least")), "least-links")
    others = links.join(least.withColumnRenamed("b", "of"), F.col("b") == F.col("of")).where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    out = written(others.union(least.select(F.col("least").alias("a"), "b")).distinct(), "stars")
    dropped(least)
    return out


def _joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (id, component) of all links so far, from those known before and the new links. Only new links are followed, each
    as an edge between known components."""
    if known is None:
        stars = _starred(links)
        out = components(stars)
        dropped(stars)
        return out
    edges = links
    for end in ("a", "b"):
        edges = edges.join(known.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    of_a, of_b = F.coalesce("of_a", "a"), F.coalesce("of_b", "b")
    edges = written(edges.select(F.least(of_a, of_b).alias("a"), F.greatest(of_a, of_b).alias("b")).where("a <> b").distinct(), "component-links")
    stars = _starred(edges)
    moved = components(stars)
    to = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
    kept = known.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    out = written(kept.union(moved.join(known, "id", "left_anti").select("id", "component")), "joined")
    for x in (edges, stars, moved, known):
        dropped(x)
    return out


def _links(members: DataFrame, marks: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Components (id, component) of the verified links among nodes that share a key.

    In the first round a key's least node is compared with all its members, so a key whose members are all similar to the first
    costs one comparison for each member, whatever its size. Nodes of keys that this leaves
    unconnected get the keys of an exact prefix join instead. Of those, some hundred members in each round are compared with
    all that no known link connects to them, and then leave the key; a key is done when links connect what is left
    of it, or none of that can be the smaller of a pair. So every possible pair is compared or already connected.
    """
    members = members.withColumns({"size": F.lit(0).cast("long"), "most": F.lit(0).cast("long")})
    known = None
    turn = 0
    while True:
        turn += 1
        state = members.withColumn("of", F.col("node"))
        if known is not None:
            state = members.join(known.select(F.col("id").alias("node"), F.col("component").alias("known")), "node", "left").select("key", "node", "size", "most", F.coalesce("known", "node").alias("of"))
        state = written(state, "round")
        keys = state.groupBy("key").agg(F.min(F.when(F.col("most") >= F.col("size"), F.col("node"))).alias("pivot"), F.min("of").alias("lo"), F.max("of").alias("hi"), F.count("*").alias("n"))
        keys = written(keys.where("lo <> hi and pivot is not null").select("key", "pivot", "n"), "pivots")
        active = written(state.join(keys, "key"), "active")
        dropped(state)
        dropped(keys)
        if active.limit(1).count() == 0:
            dropped(active)
            break
        if turn == 2:
            rest = written(active.select("node").distinct(), "unresolved")
            dropped(active)
            members = _prefix_members(rest, texts, shingle, percent)
            continue
        other = active.select(F.col("key").alias("k2"), F.col("node").alias("n2"), F.col("of").alias("of2"), F.col("size").alias("size2"), F.col("most").alias("most2"))
        meet = (F.col("key") == F.col("k2")) & (F.col("of") != F.col("of2")) & (F.col("size") <= F.col("most2")) & (F.col("size2") <= F.col("most"))
        classes = F.ceil(F.col("n") / PIVOTS)
        chosen = F.col("node") == F.col("pivot") if turn == 1 else F.pmod(F.xxhash64("node", F.lit(turn)), classes) == 0
        pivots = written(active.where(chosen), "chosen")
        pairs = other.join(pivots, meet).select(F.least("node", "n2").alias("a"), F.greatest("node", "n2").alias("b"))
        new = written(_verified(written(_plausible(pairs.distinct(), marks, percent), "plausible"), texts, shingle, percent), "links")
        members = written(active.where(~chosen).select("key", "node", "size", "most"), "members")
        dropped(active)
        dropped(pivots)
        if new.limit(1).count():
            known = _joined(known, new)
        dropped(new)
    return known if known is not None else members.sparkSession.createDataFrame([], "id long, component long")


def minhash_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, bundles: int = 16, rows: int = 3) -> DataFrame:
    """Links documents whose sets of word shingles have a Jaccard similarity of percent / 100 or more.

    Returns for each row: doc_id, n_shingles, component_id (the least doc_id reachable over links), kept (whether
    that is its own). Words are compared with A-Z lower-cased; a text of fewer words than `shingle` is one
    shingle; texts without words (null, empty) are linked with nothing. Copies are one node. Rows that repeat a
    doc_id are one document with several texts; a null doc_id counts as the least and has a null
    component_id. Other columns are ignored. An empty table gives an empty one.
    """
    docs = text_of(docs)
    sketch = written(sketches(docs, shingle, bundles, rows), "sketch")
    filled = sketch.where("n_shingles > 0")
    sets = written(filled.groupBy("set_id").agg(F.min("doc_id").alias("node")), "sets")
    nodes = written(filled.join(sets.withColumnRenamed("set_id", "own"), (F.col("doc_id") == F.col("node")) & (F.col("set_id") == F.col("own"))).select("node", "n_shingles", "left", "right", "marks").distinct(), "nodes")
    members = _members(nodes)
    candidates = written(members.select("node").distinct(), "candidates")
    texts = written(docs.withColumn("node", known_id(docs)).join(candidates, "node").select("node", "text").distinct(), "texts")
    dropped(candidates)
    known = _links(members, nodes.join(texts.select("node").distinct(), "node", "left_semi"), texts, shingle, percent)
    found = sets.join(known.withColumnRenamed("id", "node"), "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    rows_of = sketch.select("doc_id", "n_shingles", "set_id").join(written(found, "found"), "set_id", "left")
    own = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    out = rows_of.select(F.nullif(F.col("doc_id"), F.lit(NULL_ID)).alias("doc_id"), "n_shingles", F.nullif(own, F.lit(NULL_ID)).alias("component_id"), (F.col("doc_id") == own).alias("kept"))
    return sized(out)
