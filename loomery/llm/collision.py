"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Inner products become distances: a row x of a block gets the component sqrt(M^2 - |x|^2), M being the block's largest norm,
a query is scaled to length M and gets 0; then |q - x|^2 = 2 M^2 - 2 M (q.x) / |q|. Each of PROJECTIONS random directions
orders the block's rows by their projection. For a query, a window centred on its own projection is opened in each sorted
array; rows inside collide. Windows end at the borders of an array's pages. Each array keeps, as bits, the set of rows of its
first pages, for every number of pages: a window is the difference of two of these sets, and a query's collisions are added up
bit by bit over all arrays, 64 rows to a word. The first windows hold a DENSITY-th of the rows, by the density of the projections
around the query. Then they grow (virtual rehashing: the same arrays, a wider radius) towards Z times the distance that the k-th
largest count tells, by a ratio within GROWTH. Rows that collide in at least THRESHOLD of the arrays
are verified by their exact inner product in double precision. The search ends when the half width is Z times the distance
of the k-th best row verified: a row nearer than that falls into a window with probability 2 Phi(Z) - 1 or more, which
exceeds the threshold by DEVIATIONS standard deviations; so few are missed. Nothing is capped: all rows past the threshold are
verified, and windows that reach all rows end the search. `verified` and `offered` count rows, over all queries.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without vec_id;
queries meet rows of as many components only; all rows with the query's vec_id are its own, and of several the smallest
vector is the query; repeated vectors are all candidates and tie to the smaller vec_id; fewer than k candidates are all
returned; scores are the inner products in double precision, infinite ones included; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import _vectors

PROJECTIONS, Z, DEVIATIONS = 128, 1.3, 1.0
#: Least and largest growth of a window in a round; rows of a block to one in its first windows.
GROWTH, DENSITY = (1.15, 8.0), 16
#: Pages of a sorted array at most, at whose borders windows end; queries that grow their windows in step.
PAGES, STEP = 128, 128
COLLIDES = math.erf(Z / math.sqrt(2))
THRESHOLD = math.floor(PROJECTIONS * (COLLIDES - DEVIATIONS * math.sqrt(COLLIDES * (1 - COLLIDES) / PROJECTIONS)))
SEED = 7
NORMAL = NormalDist()


class CollisionIndex:
    def __init__(self, vectors: np.ndarray):
        self.vectors, self.verified, self.offered = vectors, 0, 0
        # Of one scale, so that huge and tiny components don't leave the range of numbers.
        self.unit = float(np.abs(vectors).max())
        scaled = vectors / self.unit
        squares = (scaled * scaled).sum(axis=1)
        self.norm = math.sqrt(float(squares.max()))
        self.directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        projected = np.column_stack([scaled, np.sqrt(np.maximum(0, self.norm**2 - squares))]) @ self.directions
        order = np.argsort(projected, axis=0).T
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected.T, order, axis=1))
        # For each array and each number of its first pages: the set of rows in these, as bits.
        n = len(vectors)
        self.page = -(-n // PAGES)
        pages = -(-n // self.page)
        self.first = np.zeros((PROJECTIONS, pages + 1, -(-n // 64)), np.uint64)
        for first, rows in zip(self.first, order):
            inside = np.zeros((pages + 1, first.shape[1] * 64), bool)
            inside[np.arange(n) // self.page + 1, rows] = True
            first[:] = np.bitwise_or.accumulate(np.packbits(inside, axis=1, bitorder="little").view(np.uint64), axis=0)

    def __call__(self, queries: np.ndarray, k: int, own: list[np.ndarray], least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        unit = np.abs(queries).max(axis=1, keepdims=True)
        scaled = queries / unit
        scale = self.norm / np.sqrt((scaled * scaled).sum(axis=1))
        centres = (scaled * scale[:, None]) @ self.directions[:-1]
        n, reach = len(self.vectors), max(1, k // 2, len(self.vectors) // (2 * DENSITY))
        places = np.stack([np.searchsorted(s, centres[:, j]) for j, s in enumerate(self.sorted)])
        lows, highs = np.maximum(0, places - reach), np.minimum(n - 1, places + reach)
        each = np.arange(len(self.sorted))[:, None]
        self.offered += n * len(queries)
        half = np.median(np.maximum(self.sorted[each, highs] - centres.T, centres.T - self.sorted[each, lows]), axis=0)
        # Distances by a score: 2 M^2 - 2 times the score in the block's scale.
        per_score = scale / (self.unit * unit[:, 0])
        searches = [_Search(float(least[i])) for i in range(len(queries))]
        seen = np.zeros((len(queries), self.first.shape[2]), np.uint64)
        for i, rows in enumerate(own):
            np.bitwise_or.at(seen[i], rows // 64, np.uint64(1) << (rows % 64).astype(np.uint64))
        half = np.maximum(half, 1e-9)
        with np.errstate(over="ignore", invalid="ignore"):
            for start in range(0, len(queries), STEP):
                going = np.arange(start, min(start + STEP, len(queries)))
                while going.size:  # these searches grow their windows in step
                    lo = np.stack([np.searchsorted(s, centres[going, j] - half[going], "left") for j, s in enumerate(self.sorted)])
                    hi = np.stack([np.searchsorted(s, centres[going, j] + half[going], "right") for j, s in enumerate(self.sorted)])
                    planes = self._counts(lo // self.page, -(-hi // self.page))
                    fresh = _at_least(planes, THRESHOLD) & ~seen[going]
                    seen[going] |= fresh
                    inside = np.unpackbits(fresh.view(np.uint8), axis=1, bitorder="little").view(bool)
                    partial = (lo > 0).any(axis=0) | (hi < n).any(axis=0)
                    hits = _kth_largest(planes, min(k, n))
                    on = np.zeros(len(going), bool)
                    for at, i in enumerate(going.tolist()):
                        self._verify(searches[i], np.flatnonzero(inside[at]), queries[i], k)
                        if partial[at]:
                            need = self._need(searches[i], k, float(per_score[i]))
                            on[at] = half[i] < need
                            half[i] = min(self._wider(float(hits[at]), float(half[i])), need * (1 + 1e-9))
                    going = going[on]
        return [s.found() for s in searches]

    def _counts(self, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        """In how many windows, from page lo to before page hi of each array, each row is: bit b of the counts at place b, a row of words a query."""
        weights = [[first[b] ^ first[a] for first, a, b in zip(self.first, lo, hi)]]
        planes = []
        for sets in weights:  # grows while it is read: sets of one weight add up to one, and to sets of twice the weight
            carried = []
            while len(sets) > 1:
                a, b = sets.pop(), sets.pop()
                c, either = (sets.pop() if sets else None), a ^ b
                sets.append(either if c is None else either ^ c)
                carried.append(a & b if c is None else (a & b) | (either & c))
            planes.append(sets[0])
            if carried:
                weights.append(carried)
        return planes

    def _verify(self, search: "_Search", rows: np.ndarray, query: np.ndarray, k: int) -> None:
        """Score rows that collide often enough now."""
        self.verified += len(rows)
        scores = self.vectors[rows] @ query
        if len(search.scores) == k:
            near = ~(scores < search.scores[-1])
            rows, scores = rows[near], scores[near]
        search.rows, search.scores = _vectors.top(np.concatenate([search.scores, scores]), np.concatenate([search.rows, rows]), k)

    def _need(self, search: "_Search", k: int, per_score: float) -> float:
        """The half width at which the search may end."""
        known = max(search.least, float(search.scores[-1])) if len(search.scores) == k else search.least
        return Z * math.sqrt(max(0.0, 2 * self.norm**2 - 2 * known * per_score)) if math.isfinite(known) else math.inf

    def _wider(self, hits: float, half: float) -> float:
        """Z times the distance at which a window of this half width is hit as often as the k-th of the rows hit most."""
        spread = NORMAL.inv_cdf((1 + min(PROJECTIONS - 0.5, hits) / PROJECTIONS) / 2)
        return half * min(GROWTH[1], max(GROWTH[0], Z / spread if spread > 0 else math.inf))


def _at_least(planes: list[np.ndarray], least: int) -> np.ndarray:
    """The rows whose counts are `least` or more."""
    if least >= 1 << len(planes):
        return np.zeros_like(planes[0])
    out = np.full_like(planes[0], np.iinfo(np.uint64).max)
    for bit, plane in enumerate(planes):
        out = plane & out if least >> bit & 1 else plane | out
    return out


def _kth_largest(planes: list[np.ndarray], k: int) -> np.ndarray:
    """Each query's k-th largest count."""
    among, wanted, out = np.full_like(planes[0], np.iinfo(np.uint64).max), np.full(len(planes[0]), k), np.zeros(len(planes[0]), np.int64)
    for plane in reversed(planes):
        having = among & plane
        n = np.bitwise_count(having).sum(axis=1, dtype=np.int64)
        more = n >= wanted
        out = 2 * out + more
        wanted = np.where(more, wanted, wanted - n)
        among = np.where(more[:, None], having, among & ~plane)
    return out


class _Search:
    """What a query has found in a block."""

    def __init__(self, least: float):
        self.least = least
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        keep = self.scores >= self.least
        return self.rows[keep], self.scores[keep]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k rows of largest inner product that are found."""
    return _vectors.search(_vectors.valid(rows, zero=False), _vectors.valid(queries, zero=False), k, CollisionIndex, "double")


def every(rows: DataFrame, step: int) -> DataFrame:
    """The stated query set: rows whose vec_id is divisible by step."""
    return rows.where(F.col("vec_id") % step == 0)
