"""Prefix trie of conversations, as burst tries: suffix containers under trie heads, burst by next turn while too large."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.frames import WORD, dropped, small_batches, written
from rowmill.sources.order import with_row_numbers

#: Conversations and turns that a container holds at most; a larger one is burst by its next turn.
CONTAINER, CONTAINER_TURNS = 256, 1 << 16
#: Turns that a shard of containers holds on average.
SHARD_TURNS = 1 << 14
#: Conversations of one line of ids that are put together before they are hashed.
LINE = 256

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COLUMNS = [x.split(" ")[0] for x in NODE.split(", ")]
_EMPTY = hashlib.sha256(b"").hexdigest()
_ROOT = bytes(16)


def _key(*columns: Column) -> Column:
    """128 bits of SHA-256 of some strings or binaries, each behind its length."""
    parts = [x for c in columns for x in (F.encode(F.octet_length(c).cast("string"), "UTF-8"), F.encode(F.lit(":"), "UTF-8"), c.cast("binary"))]
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), id (of role and text, 128 bits), words: every turn at its place in its conversation.

    Places come from a sort by ranges over all conversations, so a conversation of any length is many tasks' work.
    Turns of one number are ordered by role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    ranged = with_row_numbers(rows, ["conv_id", "turn", "role", "text"], column="n")
    ids = ranged.select("conv_id", "n", _key(F.col("role"), F.col("text")).alias("id"), F.regexp_count("text", F.lit(f"{WORD}+")).cast("long").alias("words"))
    placed = written(ids, "turns")
    dropped(ranged)
    first = placed.groupBy("conv_id").agg(F.min("n").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("n") - F.col("first") + 1).alias("pos"), "id", "words")


def rebuilt(placed: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, id, words) of rebuilt conversations, and their lengths (conv_id, n_turns).

    Conversation c takes the first h turns of c - c % group and its own behind its first h, h being crc32(c) % most.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    h = F.crc32(F.col("conv_id").cast("string")) % most
    own = placed.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", base.alias("base"), h.alias("h"))
    size = own.where("conv_id = base").select("base", F.least("n", F.lit(most)).alias("of_base"))
    convs = written(own.join(size, "base", "left").select("conv_id", "base", "n", "h", F.least("h", F.coalesce("of_base", F.lit(0))).alias("k")), "convs")
    start = placed.where((F.col("pos") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "pos", "id", "words")
    taken = convs.join(start, "base").where("pos <= h").select("conv_id", "pos", "id", "words")
    rest = placed.join(convs.select("conv_id", "h", "k"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "id", "words")
    return written(taken.unionByName(rest), "rebuilt"), convs.select("conv_id", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("long").alias("n_turns"))


def swept(sequences: list[tuple[list[bytes], int, list[int]]]) -> list[list]:
    """The nodes of one container: [conv_id, depth below the head, index of the parent, n_convs, n_children, n_leaves, saved_tokens, ends].

    sequences: turn ids, conversation, words of each turn; any order. They are sorted, and a sweep keeps the path of the
    sequence at hand: behind what it shares with the next one, nodes are closed. The first node is the head.
    """
    nodes: list[list] = [[min(c for _, c, _ in sequences), 0, -1, 0, 0, 0, 0, []]]
    words_of = [0]
    path, before = [0], []
    for ids, conv, words in sorted(sequences, key=lambda s: (s[0], s[1])):
        shared = 0
        for a, b in zip(ids, before):
            if a != b:
                break
            shared += 1
        del path[shared + 1 :]
        for depth in range(shared, len(ids)):
            nodes[path[-1]][4] += 1
            path.append(len(nodes))
            nodes.append([conv, depth + 1, path[-2], 0, 0, 0, 0, []])
            words_of.append(words[depth])
        nodes[path[-1]][7].append(conv)
        before = ids
    # children stand behind their parents, so from the end each node is complete when it is added to its parent
    for n in range(len(nodes) - 1, -1, -1):
        conv, _, parent, _, children, _, _, ends = node = nodes[n]
        node[3] += len(ends)
        node[0] = min([conv, *ends[:1]])
        node[5] += not children
        node[6] += (node[3] - 1) * words_of[n]
        if parent >= 0:
            above = nodes[parent]
            above[0] = min(above[0], node[0])
            for k in (3, 5, 6):
                above[k] += node[k]
    return nodes


def _hash_of(ids: Iterable[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _containers(group: pd.DataFrame) -> pd.DataFrame:
    """Sweeps the containers of a shard. A container's head gets its own words and parent, and the heads above it as `path`."""
    rows = []
    group = group.sort_values(["head", "conv_id", "pos"], kind="stable")
    for head, one in itertools.groupby(group.itertuples(index=False), key=lambda r: r.head):
        sequences, of_head = [], None
        for conv, of in itertools.groupby(one, key=lambda r: r.conv_id):
            of = list(of)
            of_head = of[0]
            real = [r for r in of if r.id is not None]
            sequences.append(([r.id for r in real], conv, [r.words for r in real]))
        nodes = swept(sequences)
        for n, (conv, depth, parent, n_convs, children, leaves, saved, ends) in enumerate(nodes):
            top = n == 0
            saved += (n_convs - 1) * of_head.head_words if top else 0
            above = of_head.parent_conv_id if top else nodes[parent][0]
            rows.append((conv, of_head.depth + depth, None if pd.isna(above) else int(above), n_convs, children, leaves, saved, _hash_of(sorted(ends)), of_head.path if top else None))
    out = pd.DataFrame(rows, columns=[*_COLUMNS, "path"])
    return out.astype({"parent_conv_id": "Int64"})


def _line_hashes(lines: DataFrame) -> DataFrame:
    """head and ends_sha256 of rows (head, line, ids): the lines of a head are hashed one behind the other, never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for head, ids in zip(batch.column("head").to_pylist(), batch.column("ids").to_pylist()):
                if head != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = head, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["head", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["head", "ends_sha256"])

    return lines.repartition("head").sortWithinPartitions("head", "line").mapInArrow(run, "head binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 20, most: int = 4, container: int = CONTAINER, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are ordered by turn (null first; turns of one number by role and text); conversation c gets the first
    h = crc32(c) % `most` turns of conversation c - c % `group` before its own behind its first h. A node is a distinct
    sequence of the first turns (role, text); the root has none.

    The first container, under the root, holds all conversations. While a container has over `container` conversations, or several with together over
    `container_turns` turns, it is burst: the next turn's id sends each conversation to a container under a new head. The others are dealt
    to shards, sorted and swept into nodes; a conversation alone in a container of over
    `container_turns` turns gives its nodes row by row. A burst head's sums come from its containers by
    one aggregate, its ends by lines of ids that are hashed in order. So no task holds a group that
    grows with the data; rounds follow the depth to which too many conversations share their turns.

    Null roles and texts are empty; rows without conv_id take no part; repeated rows are turns of their own. The remainder c % group has the
    sign of c. Equality is by 128 bits of SHA-256. Extra columns are ignored. An empty table gives no nodes.
    """
    small_batches(conversations.sparkSession)
    placed = turns(conversations)
    rows, lengths = rebuilt(placed, group, most)
    dropped(placed)
    used = [rows, lengths]
    state = lengths.select("conv_id", "n_turns", F.lit(_ROOT).alias("head"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("parent_conv_id"), F.array().cast("array<binary>").alias("path"))
    depth, kept, heads, ends, tails = 0, [], [], [], []
    while True:
        state = written(state, "heads")
        used.append(state)
        sums = state.groupBy("head").agg(F.count("*").alias("n"), F.sum(F.col("n_turns") - depth).alias("turns"), F.min("conv_id").alias("least"))
        large = written(sums.where((F.col("n") > container) | (F.col("turns") > container_turns)), "large")
        used.append(large)
        at = F.lit(depth).cast("long").alias("depth")
        if large.isEmpty():
            kept.append(state.select("*", at))
            break
        split = state.join(large, "head", "left")
        kept.append(split.where("n IS NULL").select(*state.columns, at))
        alone = (F.col("n") == 1) & (F.col("turns") > container_turns)
        tails.append(split.where(alone).select(*state.columns, at))
        burst = split.where(F.col("n").isNotNull() & ~alone)
        first = F.struct("words", "parent_conv_id", "path")  # the same for all of a head
        heads.append(burst.groupBy("head").agg(F.count("*").alias("n"), F.min("least").alias("least"), F.min(first).alias("f")).select("head", "n", "least", "f.*", at))
        ends.append(burst.where(F.col("n_turns") == depth).select("head", "conv_id"))
        step = rows.where(F.col("pos") == depth + 1).select("conv_id", "id", F.col("words").alias("next_words"))
        state = burst.join(step, "conv_id").select(
            "conv_id", "n_turns", _key(F.col("head"), F.col("id")).alias("head"), F.col("next_words").alias("words"), F.col("least").alias("parent_conv_id"), F.concat("path", F.array("head")).alias("path")
        )
        depth += 1

    found = _swept_containers(rows, kept)
    nodes = found.drop("path")
    if heads:
        tops = found.where("path IS NOT NULL").select("path", "n_leaves", "saved_tokens")
        alone = written(_union(tails), "tails")
        tops = tops.unionByName(alone.select("path", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
        upper = written(_union(heads), "upper")
        below = written(_tail_nodes(rows, alone), "tail-nodes")
        nodes = nodes.unionByName(below).unionByName(written(_upper_nodes(upper, tops, _union(ends)), "upper-nodes"))
        used += [alone, upper]
    for table in used:
        dropped(table)
    return nodes


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _swept_containers(rows: DataFrame, kept: list[DataFrame]) -> DataFrame:
    """NODE and path of all containers, shard by shard."""
    members = written(_union(kept), "containers")
    shards = max(1, members.agg(F.sum(F.col("n_turns") - F.col("depth") + 1)).first()[0] or 0) // SHARD_TURNS + 1
    inside = members.join(rows, "conv_id").where("pos > depth").select("head", "depth", "conv_id", "pos", "id", rows["words"].alias("words"), F.lit(0).cast("long").alias("head_words"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(None).cast("array<binary>").alias("path"))
    # one row for each conversation, before its turns, says what the head knows
    tops = members.select("head", "depth", "conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("words"), F.col("words").alias("head_words"), "parent_conv_id", "path")
    dealt = tops.unionByName(inside).withColumn("shard", F.pmod(F.xxhash64("head"), F.lit(shards)))
    return written(dealt.groupBy("shard").applyInPandas(lambda group: _containers(group.drop(columns="shard")), f"{NODE}, path array<binary>"), "nodes")


def _tail_nodes(rows: DataFrame, alone: DataFrame) -> DataFrame:
    """Nodes of conversations that are alone below a head: one for each turn, and one for the head."""
    ended = F.sha2(F.encode(F.col("conv_id").cast("string"), "UTF-8"), 256)
    below = alone.join(rows.select("conv_id", "pos"), "conv_id").where("pos > depth").select("conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), "n_turns")
    both = alone.select("conv_id", "depth", "parent_conv_id", "n_turns").unionByName(below)
    inner = F.col("depth") < F.col("n_turns")
    one = F.lit(1).cast("long")
    return both.select("conv_id", "depth", "parent_conv_id", one.alias("n_convs"), inner.cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(inner, F.lit(_EMPTY)).otherwise(ended).alias("ends_sha256"))


def _upper_nodes(upper: DataFrame, tops: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes of the heads that were burst; sums come from the containers and heads below them."""
    own = (F.col("n") - 1) * F.col("words")
    parents = upper.select(F.try_element_at("path", F.lit(-1)).alias("head")).where("head IS NOT NULL").unionByName(tops.select(F.try_element_at("path", F.lit(-1)).alias("head")))
    children = parents.groupBy("head").agg(F.count("*").alias("n_children"))
    known = written(upper.join(children, "head", "left").fillna(0, ["n_children"]), "upper")
    leaf = (F.col("n_children") == 0).cast("long")
    given = known.select(F.concat("path", F.array("head")).alias("path"), leaf.alias("n_leaves"), own.alias("saved_tokens")).unionByName(tops)
    sums = given.select(F.explode("path").alias("head"), "n_leaves", "saved_tokens").groupBy("head").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    numbered = with_row_numbers(written(ends, "ends"), ["head", "conv_id"], column="n")
    lines = numbered.groupBy("head", F.floor(F.col("n") / LINE).alias("line")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))
    hashes = _line_hashes(lines)
    out = known.join(sums, "head").join(hashes, "head", "left")
    return out.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))

