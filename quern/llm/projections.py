"""Approximate nearest neighbours by few stable projections and a kd-tree.

Largest inner product becomes nearest distance by one more component (the square root of what a row's
squared norm lacks to the largest). ``PROJECTIONS`` Gaussian directions map rows to a few dimensions,
where squared distance over true squared distance follows a chi-square law. A kd-tree over the projected
rows (its first levels, laid out by a sample's medians, are the cells that shards are cut from) hands out
neighbours cell by cell and leaf by leaf; a row is verified by its true score unless the stopping test
holds for it: a row nearer than the query's current kth neighbour would, with probability ``SURE``, have
a projected squared distance below quantile * (kth distance)**2. Leaves and cells that lie beyond that
as a whole are never visited. So each of the true k nearest is missed with probability 1 - ``SURE`` at
most, and mostly far less: expected recall is at least ``SURE``, whatever the data.

All rows are indexed; nothing is fitted but the medians (from a bounded sample; any cut is right) and the
largest norm, taken over all rows. Rows: see ``vectors``; zero vectors take no part.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import vectors

PROJECTIONS = 32
SURE = 0.97
SEED = 11


def chi_square(x: float, m: int) -> float:
    """Distribution function of the chi-square law with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))


def quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


class Projection:
    """Rows and queries in the few dimensions, and the stopping test there."""

    def __init__(self, width: int, largest: float, m: int = PROJECTIONS, sure: float = SURE):
        self.direction = np.random.default_rng(SEED).standard_normal((width + 1, m))
        self.largest, self.quantile = largest, quantile(sure, m)

    def rows(self, rows: np.ndarray) -> np.ndarray:
        lack = np.sqrt(np.maximum(self.largest**2 - (rows**2).sum(axis=1), 0))
        return rows @ self.direction[:-1] + lack[:, None] * self.direction[-1]

    def queries(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.direction[:-1]

    def beyond(self, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The projected squared distance at which each query's stopping test holds."""
        return self.quantile * (self.largest**2 + (queries**2).sum(axis=1) - 2 * kth)

    def score_at(self, queries: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The kth score at which the test first holds at a projected squared distance."""
        return (self.largest**2 + (queries**2).sum(axis=1)[:, None] - gap / self.quantile) / 2


def gaps(flat: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    gap = np.zeros((len(flat), len(low)))
    for d in range(flat.shape[1]):
        x = flat[:, d, None]
        gap += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0) ** 2
    return gap


class ProjectedTree:
    """kd-tree over the projections of a shard's rows."""

    def __init__(self, rows: np.ndarray, projection: Projection, leaf_rows: int = vectors.LEAF_ROWS):
        self.projection, self.flat = projection, projection.rows(rows)
        self.order, self.leaves, low, high = np.arange(len(rows)), [], [], []

        def grow(a: int, b: int) -> None:
            here = self.flat[self.order[a:b]]
            if b - a <= leaf_rows:
                self.leaves.append(slice(a, b))
                low.append(here.min(axis=0))
                high.append(here.max(axis=0))
                return
            self.order[a:b] = self.order[a:b][np.argsort(here[:, np.ptp(here, axis=0).argmax()], kind="stable")]
            half = (a + b) // 2
            grow(a, half)
            grow(half, b)

        if len(rows):
            grow(0, len(rows))
        self.low, self.high = np.array(low), np.array(high)

    def reach(self, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        return self.projection.score_at(queries, gaps(self.projection.queries(queries), self.low, self.high))

    def within(self, queries: np.ndarray, kth: np.ndarray, leaf: int) -> np.ndarray:
        a, b = self.projection.queries(queries), self.flat[self.order[self.leaves[leaf]]]
        far = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T
        return far <= self.projection.beyond(queries, kth)[:, None]


class Boxes:
    """The first levels of the kd-tree: cuts at a sample's medians, along its widest direction."""

    def __init__(self, sample: np.ndarray, n: int, projection: Projection):
        self.projection, self.cuts = projection, []  # (direction, value, left, right); below zero: -1 - cell
        flat, cells = projection.rows(sample), 0

        def grow(some: np.ndarray, want: int) -> int:
            nonlocal cells
            wide = np.ptp(some, axis=0) if len(some) else np.zeros(1)
            if want < 2 or wide.max() == 0:
                cells += 1
                return -cells
            d = int(wide.argmax())
            value = float(np.median(some[:, d]))
            me = len(self.cuts)
            self.cuts.append(None)
            low = some[:, d] < value
            self.cuts[me] = (d, value, grow(some[low], want // 2), grow(some[~low], want - want // 2))
            return me

        self.root = grow(flat, n)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        flat = self.projection.rows(rows)
        at = np.full(len(rows), self.root, np.int64)
        for node, (d, value, left, right) in enumerate(self.cuts):  # parents stand before their children
            here = at == node
            at[here] = np.where(flat[here, d] < value, left, right)
        return -1 - at

    def measure(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        flat = self.projection.rows(rows)
        return np.concatenate([flat, -flat], axis=1)

    def reach(self, queries: np.ndarray, kth: np.ndarray, cells: np.ndarray, summary: np.ndarray) -> np.ndarray:
        m = summary.shape[1] // 2
        return self.projection.score_at(queries, gaps(self.projection.queries(queries), -summary[:, m:], summary[:, :m]))

    def index(self, rows: np.ndarray) -> ProjectedTree:
        return ProjectedTree(rows, self.projection)


def nearest(table: DataFrame, every: int, k: int, column: str = "embedding", sure: float = SURE, m: int = PROJECTIONS) -> DataFrame:
    """query_id, rank, vec_id, score, verified of ``k`` rows with (nearly) the largest inner products in double precision."""
    rows = vectors.vectors(table, column, zero=False)
    x = F.filter(F.col(column).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    largest = (table.agg(F.max(norm).alias("m")).first()["m"] or 0.0) * (1 + 1e-9)
    return vectors.search(rows, every, k, lambda sample, n: Boxes(sample, n, Projection(sample.shape[1], largest, m, sure)), slack=1e-12)
