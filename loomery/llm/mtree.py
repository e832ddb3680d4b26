"""Exact top-k by inner product of whole-number vectors, by best-first search in an M-tree.

Each component x becomes floor(64 x). A row x of a block gets the component sqrt(M^2 - |x|^2), M being the block's largest
norm, and a query gets 0, so that |q - x|^2 = |q|^2 + M^2 - 2 q.x: the largest product is the smallest distance, which is a
metric. Each block of rows is bulk-loaded into a tree of pages. A page has a routing object, a covering radius, and the
distances of its entries to its routing object. Routing objects are spread: each is the entry farthest from those before.
Pages wait by their lower bound, distance less radius; a query reads its best ones first. Queries go in step: a round reads
PACE times as many pages of a query as the one before, and a page that several queries read scores for them by one product
of matrices. That
reads somewhat more pages than one after the other would. An entry whose stored distance differs from the query's
distance to the routing object by more than the k-th best distance (plus the entry's radius) can't be near enough, and no
distance to it is computed; the k-th best of the task's earlier blocks bounds the later ones. Bounds keep a margin for
rounding and pages that may tie are read; scores are sums of whole numbers, so they and their ties are exact. `computed` and
`offered` count rows, over all queries.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id; zero and empty
vectors do; queries meet rows of as many components only; all rows with the query's vec_id are its own, and of several the
smallest vector is the query; repeated vectors are all candidates and tie to the smaller vec_id; fewer than k candidates are
all returned; vectors whose products may not fit into a long stop the query with an error; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import _vectors

#: Rows of a leaf page and entries of an inner page.
LEAF, FANOUT = 64, 16
#: Pages that a query reads in a round, to those of the round before; bounds of pages that the queries of a step hold at most.
PACE, BOUNDS = 1.5, 1 << 22
#: Rounding of distances, as a share of the largest norm.
MARGIN = 1e-7


@dataclass
class Page:
    """rows and vectors of a leaf, or child pages; to_parent: the distances of these entries to this page's routing object; slack: their own radii."""

    radius: float
    to_parent: np.ndarray
    rows: np.ndarray | None = None
    vectors: np.ndarray | None = None
    children: list["Page"] | None = None
    routes: np.ndarray | None = None
    squares: np.ndarray | None = None
    slack: np.ndarray | float = 0.0
    number: int = 0

    def levels(self) -> int:
        return 1 + max((c.levels() for c in self.children or ()), default=0)


class MTree:
    def __init__(self, vectors: np.ndarray):
        """vectors: whole numbers."""
        self.computed = self.offered = 0
        self.largest = int(np.abs(vectors).max(initial=0))
        # In doubles where these hold all sums, which is faster; else in longs.
        self.vectors = vectors.astype(np.float64) if self.largest**2 * vectors.shape[1] < 2**53 else vectors
        points = vectors.astype(np.float64)
        squares = (points * points).sum(axis=1)
        self.square = float(squares.max())
        lifted = np.column_stack([points, np.sqrt(self.square - squares)])
        self.top_route = lifted[0]
        self.root = self._load(lifted, np.arange(len(vectors)), lifted[0])
        self.pages = [self.root]
        for page in self.pages:  # grows while it is read
            for child in page.children or ():
                child.number = len(self.pages)
                self.pages.append(child)

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(((a - b) ** 2).sum(axis=1))

    def _load(self, lifted: np.ndarray, rows: np.ndarray, route: np.ndarray) -> Page:
        points = lifted[rows]
        to_route = self._distances(points, route)
        radius = float(to_route.max(initial=0.0))
        if len(rows) <= LEAF or radius == 0.0:
            return Page(radius, to_route, rows=rows, vectors=self.vectors[rows])
        # Spread routing objects: each the farthest from those chosen, the first one from the page's own.
        nearest, near, seeds = to_route, np.full(len(rows), -1), []
        for s in range(min(FANOUT, -(-len(rows) // LEAF))):
            seeds.append(int(nearest.argmax()))
            to_seed = self._distances(points, points[seeds[-1]])
            closer = (to_seed < nearest) | (near < 0)
            near[closer] = s
            nearest = np.where(closer, to_seed, nearest) if s else to_seed
        groups = [(points[s], rows[near == i]) for i, s in enumerate(seeds) if (near == i).any()]
        if max(len(part) for _, part in groups) == len(rows):  # rows too much alike for the routing objects: deal them out evenly
            groups = [(lifted[part[0]], part) for part in np.array_split(rows, min(FANOUT, -(-len(rows) // LEAF)))]
        routes = np.stack([r for r, _ in groups])
        children = [self._load(lifted, part, r) for r, part in groups]
        return Page(radius, self._distances(routes, route), children=children, routes=routes, squares=(routes * routes).sum(axis=1), slack=np.array([c.radius for c in children]))

    def __call__(self, queries: np.ndarray, k: int, own: list[np.ndarray], least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        largest = int(np.abs(queries).max(initial=0))
        bound = largest * self.largest * queries.shape[1]
        if bound >= 2**63:
            raise OverflowError(f"inner products of {queries.shape[1]} components up to {largest} and {self.largest} may not fit into a long")
        if bound < 2**53 and self.vectors.dtype == np.float64:
            queries = queries.astype(np.float64)
        out, some = [], max(1, BOUNDS // len(self.pages))
        for lo in range(0, len(queries), some):
            out += _Search(self, queries[lo : lo + some], k, own[lo : lo + some], least[lo : lo + some]).run()
        return out


class _Search:
    """Queries that search a tree in step: in each round all read their own best pages, and a page scores its entries for all queries that read it."""

    def __init__(self, tree: MTree, queries: np.ndarray, k: int, own: list[np.ndarray], least: np.ndarray):
        self.tree, self.queries, self.k, n = tree, queries, k, len(queries)
        self.lifted = np.column_stack([queries.astype(np.float64), np.zeros(n)])
        self.lengths = (self.lifted * self.lifted).sum(axis=1)
        self.margin = MARGIN * (math.sqrt(tree.square) + np.sqrt(self.lengths))
        # A score of earlier blocks may have been rounded to a double.
        floors = least - np.abs(least) * 1e-15
        whole = queries.dtype != np.float64
        self.lowest = -(2**63) if whole else -math.inf
        self.kth = np.array([max(-(2**63), math.floor(x)) if math.isfinite(x) else -(2**63) for x in floors], np.int64) if whole else floors.astype(np.float64)
        self.best, self.best_rows = np.full((n, k), self.lowest, queries.dtype), np.full((n, k), -1)
        self.own = np.concatenate([i * len(tree.vectors) + rows for i, rows in enumerate(own)]) if own else np.zeros(0, np.int64)
        # Of every page that a query may read: its lower bound, and the distance of its routing object.
        self.bound, self.to_route = np.full((n, len(tree.pages)), math.inf), np.zeros((n, len(tree.pages)))
        self.to_route[:, 0] = np.sqrt(((self.lifted - tree.top_route) ** 2).sum(axis=1))
        self.bound[:, 0] = np.maximum(0.0, self.to_route[:, 0] - tree.root.radius - self.margin)
        self.reach = self._reached(np.arange(n))
        tree.offered += n * len(tree.vectors)

    def _reached(self, some: np.ndarray) -> np.ndarray:
        """The distance of the k-th best score, with the margin."""
        known = self.kth[some] > self.lowest
        inside = np.maximum(0.0, self.lengths[some] + self.tree.square - 2 * np.where(known, self.kth[some], 0).astype(np.float64))
        return np.where(known, np.sqrt(inside) + self.margin[some], math.inf)

    def run(self) -> list[tuple[np.ndarray, np.ndarray]]:
        going, take = np.arange(len(self.queries)), 1.0
        while going.size:
            near, count = self.bound[going], min(math.ceil(take), len(self.tree.pages))
            picked = np.argpartition(near, count - 1, axis=1)[:, :count]
            near = np.take_along_axis(near, picked, 1)
            at, column = np.nonzero(np.isfinite(near) & (near <= self.reach[going, None]))
            asking, pages = going[at], picked[at, column]
            self.bound[asking, pages] = math.inf
            order = np.argsort(pages, kind="stable")
            asking, pages = asking[order], pages[order]
            starts = np.flatnonzero(np.diff(pages, prepend=-1))
            found = []
            for number, some in zip(pages[starts].tolist(), np.split(asking, starts[1:])):
                page = self.tree.pages[number]
                if page.children is None:
                    found.append(self._score(page, some))
                else:
                    self._open(page, some)
            if found:
                self._merge(*map(np.concatenate, zip(*found)))
            going, take = going[np.unique(at)], take * PACE
        return [(rows[rows >= 0], scores[rows >= 0].astype(np.int64)) for rows, scores in zip(self.best_rows, self.best)]

    def _open(self, page: Page, some: np.ndarray) -> None:
        """Give these queries the bounds of the page's children, but for those that the stored distances exclude."""
        reach, margin = self.reach[some, None], self.margin[some, None]
        open_ = np.abs(page.to_parent - self.to_route[some, page.number][:, None]) <= reach + page.slack + margin
        at = np.flatnonzero(open_.any(axis=0))
        to = np.sqrt(np.maximum(0.0, page.squares[at] + self.lengths[some, None] - 2 * (self.lifted[some] @ page.routes[at].T)))
        bound = np.maximum(0.0, to - page.slack[at] - margin)
        numbers = np.array([page.children[i].number for i in at.tolist()], np.int64)
        self.to_route[some[:, None], numbers] = to
        self.bound[some[:, None], numbers] = np.where(open_[:, at] & (bound <= reach), bound, math.inf)

    def _score(self, page: Page, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, rows and scores of the page's entries that may be among the best."""
        near = np.abs(page.to_parent - self.to_route[some, page.number][:, None]) <= (self.reach + self.margin)[some, None]
        asked = int(np.count_nonzero(near))
        if 2 * asked < near.size:
            i, j = np.nonzero(near)
            scores = np.einsum("ij,ij->i", page.vectors[j].astype(self.queries.dtype), self.queries[some[i]])
            keep = scores >= self.kth[some[i]]
            i, j, scores = i[keep], j[keep], scores[keep]
        else:  # half or more: the whole page is scored by a product of matrices
            asked = near.size
            every = self.queries[some] @ page.vectors.astype(self.queries.dtype, copy=False).T
            i, j = np.nonzero(every >= self.kth[some, None])
            scores = every[i, j]
        self.tree.computed += asked
        return some[i], page.rows[j], scores

    def _merge(self, asking: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """The k best of what each query had and these, without its own rows; ties go to the smaller row."""
        if len(self.own):
            other = ~np.isin(asking * len(self.tree.vectors) + rows, self.own)
            asking, rows, scores = asking[other], rows[other], scores[other]
        changed = np.unique(asking)
        old_rows = self.best_rows[changed]
        had = old_rows >= 0
        asking = np.concatenate([asking, np.repeat(changed, had.sum(axis=1))])
        rows, scores = np.concatenate([rows, old_rows[had]]), np.concatenate([scores, self.best[changed][had]])
        order = np.lexsort((rows, -scores, asking))
        asking, rows, scores = asking[order], rows[order], scores[order]
        starts = np.flatnonzero(np.diff(asking, prepend=-1))
        rank = np.arange(len(asking)) - np.repeat(starts, np.diff(starts, append=len(asking)))
        first = rank < self.k
        self.best[asking[first], rank[first]], self.best_rows[asking[first], rank[first]] = scores[first], rows[first]
        full = changed[self.best_rows[changed, -1] >= 0]
        self.kth[full] = np.maximum(self.kth[full], self.best[full, -1])
        self.reach[full] = np.minimum(self.reach[full], self._reached(full))


def whole(rows: DataFrame) -> DataFrame:
    """Each component x as floor(64 x), in longs; an error beyond their range."""
    out = F.raise_error(F.lit("a component times 64 does not fit into a long"))
    return rows.withColumn("embedding", F.transform("embedding", lambda x: F.when(F.abs(x * 64) < 2.0**63, F.floor(x * 64)).otherwise(out.cast("long"))))


def top_products(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k rows of largest whole-number inner product."""
    return _vectors.search(whole(_vectors.valid(rows, zero=True)), whole(_vectors.valid(queries, zero=True)), k, MTree, "long")
