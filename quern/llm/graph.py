"""Connected components by alternating large and small stars, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.spark import by_key, dropped, written


def _print(edges: DataFrame) -> tuple[int, int]:
    """How many distinct edges there are, and a hash of the set: an exclusive or, as a sum of hashes overflows beyond some 100,000."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (columns ``a``, ``b``): node, root. Nodes without edges are not listed.

    A node with very many neighbours is joined by broadcast (``by_key``), so no task gets all of its edges.
    """
    least = lambda d: d.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c"))
    ordered = lambda d: d.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(ordered(edges))
    seen = _print(edges)
    while seen[0]:
        both = edges.union(edges.select("b", "a"))
        m = written(least(both).select("a", F.least("a", "m").alias("m"), "c"))
        large = written(ordered(by_key(both, m, "a", "c", 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        n = written(least(large))
        small = by_key(large, n, "a", "c", seen[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).union(n.select("a", "m"))
        before, edges = edges, written(ordered(small))
        for done in (before, m, large, n):
            dropped(done)
        now = _print(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
