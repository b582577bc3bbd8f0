"""Hard negatives by inner product: cover trees in shards, searched by blocks of anchors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.cover_tree import Best, CoverTree, augmented, bounds, exact_kind
from rowmill.llm.frames import dropped, hash_sample, small_batches, written

#: Balls that all rows are dealt to, and rows of the bounded sample that their centres are chosen from.
BALLS, SAMPLE = 32, 1024
#: Rows of a shard, each with its own tree, and anchors of a block, on average.
SHARD, BLOCK = 4096, 512
#: A score beyond all windows.
_END = (1 << 63) - 1

_HIT = "anchor_id long, w int, score long, vec_id long"
_QUERY = "anchor_id long, label long, v array<long>, low array<long>, high array<long>, floor array<long>"


def quantised(embeddings: DataFrame, scale: int = 256, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, v (components floor(scale * x)) of the rows that take part; one row for each vec_id."""
    x = F.col("embedding").cast("array<double>").alias("x")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x)
    live = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))")
    label = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    one = live.select("vec_id", F.struct(label.alias("label"), F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v")).alias("r"))
    return one.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(vectors: pd.Series, dims: int, kind: type = np.int64) -> np.ndarray:
    """Vectors as rows; missing components are 0."""
    if all(len(v) == dims for v in vectors):
        out = np.array(vectors.tolist(), dtype=np.int64).reshape(len(vectors), dims)
    else:
        out = np.zeros((len(vectors), dims), dtype=np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
    return out.astype(kind)


class Index:
    """Cover trees of all rows: rows are dealt to the ball of the nearest of some centres, and a ball's rows by a hash to shards of some thousand.

    The centres are chosen from a bounded sample, each the farthest from those before; every row is in a tree. A table in
    spark.checkpoint.dir holds a row for each shard; what the driver holds of it is BALLS radii and counts.
    """

    def __init__(self, rows: DataFrame, balls: int = BALLS, shard: int = SHARD):
        facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", lambda e: F.abs(e)))).alias("largest"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)).alias("norm2")).first()
        self.n, self.dims = facts["n"], max(1, facts["dims"] or 0)
        self.kind = exact_kind(facts["largest"] or 0, self.dims)
        self.norm2 = norm2 = float(facts["norm2"] or 0.0) * (1 + 1e-12)
        self.centres, self.products = self._chosen(rows, balls)
        centres, dims = self.centres, self.dims

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    points = augmented(_matrix(b["v"], dims), norm2)
                    square = np.maximum(0.0, (points * points).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * points @ centres.T)
                    ball = square.argmin(axis=1)
                    away = points - centres[ball]  # the difference itself: less rounding than the products
                    yield b.assign(ball=ball.astype(np.int32), away=np.sqrt((away * away).sum(axis=1)))

        dealt = written(rows.select("vec_id", "label", "v").mapInPandas(deal, "vec_id long, label long, v array<long>, ball int, away double"), "dealt")
        self.balls = {r["ball"]: (r["n"], r["radius"]) for r in dealt.groupBy("ball").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
        self.shards = {ball: math.ceil(n / shard) for ball, (n, _) in self.balls.items()}
        of = F.create_map(*(F.lit(x) for pair in self.shards.items() for x in pair)) if self.shards else None
        salted = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id"), of[F.col("ball")]).cast("int") if self.shards else F.lit(0))

        def build(group: pd.DataFrame) -> pd.DataFrame:
            tree = CoverTree.built(group["vec_id"].to_numpy(), group["label"].to_numpy(), _matrix(group["v"], dims), norm2)
            return pd.DataFrame({"ball": group["ball"].iloc[:1], "shard": group["shard"].iloc[:1], "tree": [tree.packed()]})

        self.trees = written(salted.groupBy("ball", "shard").applyInPandas(build, "ball int, shard int, tree binary"), "trees")
        dropped(dealt)

    def _chosen(self, rows: DataFrame, balls: int) -> tuple[np.ndarray, np.ndarray]:
        """Centres in the augmented space, and their own vectors (a query's products with them need no more)."""
        sample = hash_sample(rows, SAMPLE, "vec_id").select("v").toPandas()["v"]
        if not len(sample):
            return np.zeros((1, self.dims + 1)), np.zeros((1, self.dims))
        points = augmented(_matrix(sample, self.dims), self.norm2)
        chosen = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())]
        far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < balls and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        return points[chosen], points[chosen][:, :-1]

    def search(self, queries: DataFrame, same: bool, most: int) -> DataFrame:
        """anchor_id, w, score, vec_id: for window w of each query the first `most` rows by score downwards, then vec_id.

        queries: anchor_id (its own row is no hit), label, v, and arrays low, high of windows. `same` asks for rows of the
        query's label, else for others. Each query goes first to the ball that can hold the best rows, and then, with the scores found
        there as floors, to all balls that can still hold better ones.
        """
        count = queries.count()
        if not self.shards or not count:
            return queries.sparkSession.createDataFrame([], _HIT)
        blocks = math.ceil(count / BLOCK)
        queries = queries.withColumn("floor", F.transform("low", lambda _: F.lit(None).cast("long")))
        first = written(self._best(self._visited(queries, True, same, most, blocks), most), "first")
        floors = first.groupBy("anchor_id", "w").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == most)
        floors = floors.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("known"))
        raised = queries.join(floors, "anchor_id", "left").withColumn("floor", F.transform("low", lambda _, i: F.try_element_at("known", i.cast("int")))).drop("known")
        rest = self._visited(raised, False, same, most, blocks)
        hits = written(self._best(first.unionByName(rest), most), "hits")
        dropped(first)
        return hits

    @staticmethod
    def _best(hits: DataFrame, most: int) -> DataFrame:
        place = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most).drop("rank")

    def _visited(self, queries: DataFrame, first: bool, same: bool, most: int, blocks: int) -> DataFrame:
        """The best rows of each query in each shard that it visits: of its best ball, or of all others that it reaches."""
        dims, norm2, kind = self.dims, self.norm2, self.kind
        ball = np.array(sorted(self.balls))
        radius, shards = np.array([self.balls[b][1] for b in ball]), [self.shards[b] for b in ball]
        vectors = self.products[ball]

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows, to, shard = [], [], []
                for i, (v, low, high, floor) in enumerate(zip(_matrix(b["v"], dims).astype(np.float64), b["low"], b["high"], b["floor"])):
                    products = vectors @ v
                    least, greatest = bounds(products, radius, float(v @ v), norm2)
                    reach = Best(list(low), list(high), most, [None] * len(low)).reached(least, greatest)
                    # the ball whose rows can have the best score that a window takes
                    home = int(np.where(reach, np.minimum(greatest, float(max(high, default=0))), -np.inf).argmax()) if reach.any() else -1
                    known = [None if f is None or f != f else int(f) for f in floor]
                    reach = Best(list(low), list(high), most, known).reached(least, greatest)
                    for n in [home] if first and home >= 0 else [] if first else [x for x in np.flatnonzero(reach) if x != home]:
                        rows += [i] * shards[n]
                        to += [int(ball[n])] * shards[n]
                        shard += range(shards[n])
                yield b.iloc[rows].assign(ball=np.array(to, dtype=np.int32), shard=np.array(shard, dtype=np.int32))

        dealt = queries.select(*(c.split(" ")[0] for c in _QUERY.split(", "))).mapInPandas(deal, f"{_QUERY}, ball int, shard int")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"))
        trees = self.trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def hits(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
            found: list[tuple[int, int, int, int]] = []
            for data in index["tree"] if len(asked) else ():
                tree = CoverTree.unpacked(data).typed(kind)
                for anchor, label, query, low, high, floor in zip(asked["anchor_id"], asked["label"], _matrix(asked["v"], dims, kind), asked["low"], asked["high"], asked["floor"]):
                    best = Best([int(x) for x in low], [int(x) for x in high], most, [None if f is None or f != f else int(f) for f in floor])
                    tree.search(query, int(label), same, int(anchor), best)
                    found += [(anchor, w, -score, row) for w, rows in enumerate(best.found) for score, row in rows]
            return pd.DataFrame(found, columns=["anchor_id", "w", "score", "vec_id"])

        keys = ("ball", "shard", "block")
        return dealt.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(hits, _HIT)


def hard_negatives(embeddings: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, floor_percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null vec_id, label or vector, or a component that is null or not finite, take no part; components become floor(256 x), and
    where vec_id is divisible by 7 the label becomes (label + 1) % 10. Anchors are the rows whose vec_id is divisible by
    `anchor_every`; an anchor's positives are its first `positives` other rows of its label by inner product (then by
    vec_id), and for each the first `negatives` rows of other labels with a score from floor_percent % of the positive's up to it are returned.

    The rows are indexed whole by cover trees over vectors with one more component that makes all norms equal; a ball of a tree then
    bounds the inner products of all its rows. Anchors go in blocks to the shards whose balls reach their windows. Exact:
    products are made in doubles, 64-bit integers or Python's own, as the components demand; a score beyond a long is an error.

    Vectors of several lengths count as filled up with zeros. Of rows with one vec_id the one with the least label, then vector, takes part; equal vectors are ties,
    by vec_id, and are spread over shards. Extra columns are ignored. An empty table, or one without anchors, gives an empty one.
    """
    small_batches(embeddings.sparkSession)
    rows = written(quantised(embeddings), "vectors")
    index = Index(rows)
    anchors = rows.where(F.col("vec_id") % anchor_every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "v")
    everything = anchors.withColumns({"low": F.array(F.lit(-_END)), "high": F.array(F.lit(_END))})
    first = index.search(everything, True, positives)
    place = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    placed = first.select("anchor_id", (F.row_number().over(place) - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    of = placed.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "positive_score"))), lambda s: s["positive_score"]).alias("high"))
    # floor_percent * positive <= 100 * negative
    low = F.transform("high", lambda s: F.ceil(s.cast("decimal(38,0)") * floor_percent / 100).cast("long"))
    second = index.search(anchors.join(of, "anchor_id").withColumn("low", low), False, negatives)
    dropped(index.trees)
    dropped(rows)
    rank = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    ranked = second.select("anchor_id", "w", F.row_number().over(rank).alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return placed.join(ranked, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

