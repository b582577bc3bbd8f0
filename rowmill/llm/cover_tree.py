"""Cover trees over norm-augmented vectors: exact search by inner product within windows of scores."""

from __future__ import annotations

import heapq
import io

import numpy as np

#: Rows of a node that are verified together.
LEAF = 32
#: What rounding may add to a bound, as a share of the largest product.
SLACK = 1e-9


def exact_kind(largest: int, dims: int) -> type:
    """The number type in which inner products of components up to `largest` are exact: doubles, 64-bit integers, or Python's own."""
    most = int(largest) ** 2 * max(1, dims)
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def augmented(vectors: np.ndarray, norm2: float) -> np.ndarray:
    """vectors with one more component, so that all have the squared norm `norm2`; a query has 0 there, so near is what has a high inner product."""
    v = vectors.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(0.0, norm2 - (v * v).sum(axis=1)))])


def bounds(product: np.ndarray, radius: np.ndarray, query2: float, norm2: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product of a query with any point within `radius` of centres whose product with it is given."""
    both = query2 + norm2
    d = np.sqrt(np.maximum(0.0, both - 2.0 * product.astype(np.float64)))
    slack = SLACK * (both + 1.0)
    near = np.maximum(0.0, d - radius)
    return (both - (d + radius) ** 2) / 2 - slack, (both - near * near) / 2 + slack


class Best:
    """For each of a query's windows [low, high] the `most` best rows, by score downwards, then by id."""

    def __init__(self, low: list[int], high: list[int], most: int, floor: list[int | None]):
        self.low, self.high, self.most = low, high, most
        self.found: list[list[tuple[int, int]]] = [[] for _ in low]
        # what a row must reach at least: the window's end, or the last of the best that are known
        self.floor = [lo if f is None else max(lo, f) for lo, f in zip(low, floor)]

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for w in range(len(self.low)):
            inside = np.flatnonzero((scores >= self.floor[w]) & (scores <= self.high[w]))
            if len(inside):
                best = self.found[w] + [(-int(scores[i]), int(ids[i])) for i in inside[np.lexsort((ids[inside], -scores[inside]))[: self.most]]]
                self.found[w] = sorted(best)[: self.most]
                if len(self.found[w]) == self.most:
                    self.floor[w] = max(self.floor[w], -self.found[w][-1][0])

    def reached(self, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
        """Whether rows with scores between these bounds can still matter to a window."""
        out = np.zeros(len(least), dtype=bool)
        for low, high in zip(self.floor, self.high):
            out |= (greatest >= low) & (least <= high)
        return out


class CoverTree:
    """Level-wise cover tree: children of a node stand more than the next level's radius apart and cover its rows within it.

    A node's rows are neighbours in the arrays; `radius` is the distance of its farthest row from its centre, at most its level's
    covering radius. Rows that are equal end together in one leaf.
    """

    def __init__(self, ids, labels, vectors, start, end, centre, radius, child, children, norm2):
        self.ids, self.labels, self.start, self.end, self.centre, self.radius = ids, labels, start, end, centre, radius
        self.child, self.children, self.norm2 = child, children, float(norm2)
        self.vectors = vectors
        least = np.array([labels[s:e].min() for s, e in zip(start, end)])
        most = np.array([labels[s:e].max() for s, e in zip(start, end)])
        self.only = np.where(least == most, least, -(1 << 62))  # the label of all rows of a node
        self.least, self.most = least, most

    @classmethod
    def built(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norm2: float) -> CoverTree:
        points = augmented(vectors, norm2)
        order = np.argsort(ids, kind="stable")
        rows = order
        middle = points.mean(axis=0)
        top = rows[np.argmin(((points[rows] - middle) ** 2).sum(axis=1))]

        def away(members: np.ndarray, c: int) -> np.ndarray:
            difference = points[members] - points[c]
            return np.sqrt(np.einsum("ij,ij->i", difference, difference))

        whole = float(away(rows, top).max(initial=0.0))
        # start, end, centre, radius, child, children
        nodes = [[0, len(rows), top, whole, 0, 0]]
        placed = rows.copy()
        open_nodes = [(0, whole)]  # with the covering radius of its level
        while open_nodes:
            next_nodes = []
            for n, cover in open_nodes:
                start, end, c, radius, _, _ = nodes[n]
                if end - start <= LEAF or radius == 0.0:
                    continue
                while cover / 2 >= radius:  # levels on which the node is its own only child
                    cover /= 2
                cover /= 2
                members, at = placed[start:end].copy(), start
                first = len(nodes)
                while len(members):
                    d = away(members, c)
                    mine = d <= cover
                    mine |= members == c
                    taken = members[mine]
                    placed[at : at + len(taken)] = taken
                    nodes.append([at, at + len(taken), c, float(d[mine].max(initial=0.0)), 0, 0])
                    next_nodes.append((len(nodes) - 1, cover))
                    at += len(taken)
                    members = members[~mine]
                    if len(members):
                        c = members[np.argmax(d[~mine])]
                nodes[n][4:] = [first, len(nodes) - first]
            open_nodes = next_nodes
        start, end, centre, radius, child, children = (np.array(x) for x in zip(*nodes))
        where = np.empty(len(placed), dtype=np.int64)
        where[placed] = np.arange(len(placed))
        return cls(ids[placed], labels[placed], vectors[placed], start, end, where[centre.astype(np.int64)], radius.astype(np.float64), child, children, norm2)

    def packed(self) -> bytes:
        out = io.BytesIO()
        kind = np.int16 if self.vectors.size and np.abs(self.vectors).max() < 1 << 15 else np.int64
        np.savez(out, ids=self.ids, labels=self.labels, vectors=self.vectors.astype(kind), start=self.start, end=self.end, centre=self.centre, radius=self.radius, child=self.child, children=self.children, norm2=self.norm2)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as f:
            return cls(**{k: f[k] for k in f.files})

    def typed(self, kind: type) -> CoverTree:
        """The tree with vectors in the number type that products are made in."""
        self.vectors = self.vectors.astype(np.int64).astype(kind) if kind is object else self.vectors.astype(kind)
        return self

    def search(self, query: np.ndarray, label: int, same: bool, but: int | None, best: Best) -> None:
        """Best-first descent: nodes by the greatest product they can hold; nodes that miss all windows, or hold no row of a fit label, are skipped."""
        query2 = float((query.astype(np.float64) ** 2).sum())

        def verified(rows: np.ndarray, scores: np.ndarray) -> None:
            fit = (self.labels[rows] == label) == same
            if but is not None:
                fit &= self.ids[rows] != but
            if fit.any():
                best.offer(scores[fit], self.ids[rows[fit]])

        def told(nodes: np.ndarray, products: np.ndarray) -> None:
            least, greatest = bounds(products, self.radius[nodes], query2, self.norm2)
            use = best.reached(least, greatest)
            use &= (self.least[nodes] <= label) & (label <= self.most[nodes]) if same else self.only[nodes] != label
            single = use & (self.end[nodes] - self.start[nodes] == 1)
            if single.any():  # the centre is the row: its product is its score
                verified(self.start[nodes[single]], products[single])
            for i in np.flatnonzero(use & ~single):
                heapq.heappush(heap, (-float(greatest[i]), float(least[i]), int(nodes[i])))

        heap: list[tuple[float, float, int]] = []
        if len(self.ids):
            told(np.array([0]), self.vectors[self.centre[:1]] @ query)
        while heap:
            greatest, least, n = heapq.heappop(heap)
            if not best.reached(np.array([least]), np.array([-greatest]))[0]:
                continue
            if self.children[n]:
                nodes = np.arange(self.child[n], self.child[n] + self.children[n])
                told(nodes, self.vectors[self.centre[nodes]] @ query)
            else:
                rows = np.arange(self.start[n], self.end[n])
                verified(rows, self.vectors[rows] @ query)
