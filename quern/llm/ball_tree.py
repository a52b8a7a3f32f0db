"""Exact top-k inner-product search by ball trees: branch and bound over balls.

Vectors go to the nearest of some seeded centres; a ball with centre c and radius r holds no product with
q above q.c + |q| r, so whole shards are skipped by the kth score that a query brings along. Inside a
shard a tree splits the rows along the direction between two far points until a ball holds at most
``LEAF_ROWS``; balls under the current kth score are cut with all that they hold, level by level, and the
remaining leaves are visited by upper bound. Rows: see ``vectors``. Scores are exact integers: products
that double precision may not hold are taken in 64-bit integers, and vectors whose products may not fit
these either are refused.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.llm import vectors


#: What sums of doubles may be off, in parts of the norms.
SLACK = 1e-12


class BallTree:
    def __init__(self, rows: np.ndarray, leaf_rows: int = vectors.LEAF_ROWS):
        self.order, self.leaves = np.arange(len(rows)), []
        centre, radius, self.children, self.leaf_of = [], [], [], []

        def grow(a: int, b: int) -> int:
            here, me = rows[self.order[a:b]], len(centre)
            middle = here.mean(axis=0)
            far = np.linalg.norm(here - middle, axis=1)
            centre.append(middle)
            radius.append(far.max() * (1 + 1e-12) + 1e-9)
            self.children.append(None)
            self.leaf_of.append(-1)
            one = here[far.argmax()]
            side = here @ (here[np.linalg.norm(here - one, axis=1).argmax()] - one)
            if b - a <= leaf_rows or np.ptp(side) == 0:
                for at in range(a, b, leaf_rows):  # equal rows may outnumber a leaf
                    if at > a:
                        centre.append(middle)
                        radius.append(radius[me])
                        self.children.append(None)
                        self.leaf_of.append(-1)
                    self.leaf_of[-1 if at > a else me] = len(self.leaves)
                    self.leaves.append(slice(at, min(at + leaf_rows, b)))
                return me
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argsort(side, kind="stable")]
            self.children[me] = (grow(a, a + half), grow(a + half, b))
            return me

        if len(rows):
            grow(0, len(rows))
        self.centre, self.radius = np.array(centre), np.array(radius)

    def reach(self, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(queries, axis=1)[:, None]
        top = queries @ self.centre.T + norm * (self.radius + SLACK * np.linalg.norm(self.centre, axis=1))
        out = np.full((len(queries), len(self.leaves)), -np.inf)
        alive = np.ones(top.shape, bool)
        for node, pair in enumerate(self.children):  # parents stand before their children
            if pair is None:
                continue
            open_ = alive[:, node] & (top[:, node] >= kth)
            for child in pair:
                alive[:, child] = open_
        for node, leaf in enumerate(self.leaf_of):
            if leaf >= 0:
                out[:, leaf] = np.where(alive[:, node], top[:, node], -np.inf)
        return out

    def within(self, queries: np.ndarray, kth: np.ndarray, leaf: int) -> None:
        return None


class Centres:
    """Cells around seeded centres: every vector belongs to the nearest."""

    def __init__(self, sample: np.ndarray, n: int):
        # Far points first: each next centre is the sampled vector farthest from all centres so far.
        chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1) if len(sample) else np.zeros(0)
        while len(chosen) < n and len(sample) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        self.centre = sample[chosen] if len(sample) else None

    def assign(self, rows: np.ndarray) -> np.ndarray:
        if self.centre is None:
            return np.zeros(len(rows), np.int64)
        return (2 * rows @ self.centre.T - (self.centre**2).sum(axis=1)).argmax(axis=1)

    def measure(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        centre = 0.0 if self.centre is None else self.centre[cells]
        return np.linalg.norm(rows - centre, axis=1, keepdims=True) * (1 + 1e-12) + 1e-9

    def reach(self, queries: np.ndarray, kth: np.ndarray, cells: np.ndarray, summary: np.ndarray) -> np.ndarray:
        if self.centre is None:
            return np.linalg.norm(queries, axis=1)[:, None] * summary[:, 0]
        centre = self.centre[cells]
        return queries @ centre.T + np.linalg.norm(queries, axis=1)[:, None] * (summary[:, 0] + SLACK * np.linalg.norm(centre, axis=1))

    def index(self, rows: np.ndarray) -> BallTree:
        return BallTree(rows)


def whole(x: np.ndarray) -> np.ndarray:
    """Components as integers: floor(64 x)."""
    return np.floor(64.0 * x)


def top(table: DataFrame, every: int, k: int, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long), verified (rows scored) of the ``k`` largest integer inner products."""
    finite = F.filter(F.col(column).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    parts = table.where(F.col("vec_id").isNotNull()).select(finite.alias("x")).agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("x"), F.max(F.size("x")).alias("d")).first()
    most = (64.0 * (parts["x"] or 0.0) + 1) ** 2 * max(parts["d"] or 1, 1)
    if most >= 2.0**63:
        raise QueryError("score_out_of_range", "inner products may not fit 64-bit integers")
    rows = vectors.vectors(table, column, fit=whole)
    if most < 2.0**53:  # sums of integers below this are exact in doubles, in any order
        return vectors.search(rows, every, k, Centres).withColumn("score", F.col("score").cast("long"))
    return vectors.search(rows, every, k, Centres, SLACK, "long")
