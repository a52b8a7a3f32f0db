"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to). A flow
network sends each pattern's words to the quotas of its sources; the r-th pass over a pattern costs
2r - 1 a word, so total cost is convex and repetition is spread before it is stacked. Patterns and
sources are few (more than ``MOST_PATTERNS`` are refused), so the driver solves the network on the
aggregate. Each pattern's flow then becomes whole passes over its documents plus a remainder that seeded
documents fill: in the order of a seeded hash, each document that still fits is taken. Spark finds where
that walk must skip a document by histograms of the hash, refined bin by bin, so neither documents nor
bins are gathered anywhere; it ends when what is left is under ``NEAR`` of the remainder, or nothing fits.

Sizes count ``[^\\x20\\x09-\\x0D]+`` words; null and empty texts have size 0 and are never taken. A
null source is a source of its own. Rows that repeat a document (same id and text) are taken or left
together; rows of one id with other texts stand alone. Reruns agree: the choice depends on ids, texts
and the seed. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.llm.spark import written

MAX_PASSES = 3
#: Share of a pattern's remainder that may be left unfilled.
NEAR = 0.0005
#: Most membership patterns; a column with more is no source to mix by.
MOST_PATTERNS = 10_000
#: Bins that one histogram brings to the driver, over all patterns.
BINS = 1 << 16
DRAW_BITS = 62


def targets(sizes: dict, weights: dict, passes: int = MAX_PASSES) -> dict:
    """Quotas: the whole size shared by weight, none above ``passes`` times its source's size."""
    out = {s: 0.0 for s in sizes}
    total, free = float(sum(sizes.values())), {s for s in sizes if sizes[s] > 0}
    while free:
        scale = sum(weights[s] for s in free)
        over = {s for s in free if total * weights[s] / scale > passes * sizes[s]}
        if not over:
            out |= {s: total * weights[s] / scale for s in free}
            break
        for s in over:
            out[s] = float(passes * sizes[s])
            total -= out[s]
        free -= over
    return out


def route(patterns: dict[tuple, int], quotas: dict, passes: int = MAX_PASSES) -> dict[tuple, int]:
    """Words taken of each pattern: a min-cost flow by successive shortest paths.

    Arcs: source of flow -> pattern, once per pass, with the pattern's size and cost 2r - 1; pattern
    -> its sources, free; source -> sink, with its quota. A source without a quota takes nothing.
    """
    names = [("flow",), *(("pattern", p) for p in patterns), *(("source", s) for s in quotas), ("sink",)]
    node = {x: i for i, x in enumerate(names)}
    start, sink = 0, len(names) - 1
    head: list[list[int]] = [[] for _ in names]
    to, room, cost = [], [], []

    def arc(a: int, b: int, cap: int, c: int) -> int:
        for x, y, k, w in ((a, b, cap, c), (b, a, 0, -c)):
            head[x].append(len(to))
            to.append(y)
            room.append(k)
            cost.append(w)
        return len(to) - 2

    used = {p: [arc(start, node["pattern", p], size, 2 * r - 1) for r in range(1, passes + 1)] for p, size in patterns.items()}
    for p, size in patterns.items():
        for s in filter(quotas.__contains__, p):
            arc(node["pattern", p], node["source", s], passes * size, 0)
    for s, quota in quotas.items():
        arc(node["source", s], sink, quota, 0)
    height = [0] * len(names)
    while True:
        far, via = [math.inf] * len(names), [-1] * len(names)
        far[start] = 0
        heap = [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in head[a]:
                if room[e] > 0 and (n := d + cost[e] + height[a] - height[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if far[sink] == math.inf:
            break
        height = [h + (d if d < math.inf else 0) for h, d in zip(height, far, strict=True)]
        path, a = [], sink
        while a != start:
            path.append(via[a])
            a = to[via[a] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return {p: sum(room[e ^ 1] for e in arcs) for p, arcs in used.items()}


def word_count(column: str) -> F.Column:
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(rows: DataFrame, rests: dict[int, int], near: float = NEAR) -> list[tuple[int, int, int, int]]:
    """Which rows (pattern, draw, size) fill each pattern's remainder: (pattern, low, high, most) takes low <= draw < high of size <= most.

    The stretches of one greedy walk in the order of ``draw``: a stretch ends before a draw whose rows no longer fit.
    """
    spark, bits = rows.sparkSession, max(1, (BINS // max(len(rests), 1)).bit_length() - 1)
    stretches: list[tuple[int, int, int, int]] = []
    walks = {p: {"low": 0, "left": r, "from": 0, "upto": 1 << DRAW_BITS, "shift": DRAW_BITS - bits, "taken": 0} for p, r in rests.items() if r > 0}
    while walks:
        state = [(p, w["low"], w["left"], w["from"], w["upto"] - 1, w["shift"]) for p, w in walks.items()]
        state = F.broadcast(spark.createDataFrame(state, "pattern int, low long, most long, a long, b long, shift int"))  # one row a pattern
        here = rows.join(state, "pattern").where((F.col("draw") >= F.col("low")) & F.col("draw").between(F.col("a"), F.col("b")) & (F.col("size") > 0) & (F.col("size") <= F.col("most")))
        bins = here.groupBy("pattern", F.expr("shiftright(draw, shift)").alias("bin")).agg(F.sum("size").alias("n"), F.min("draw").alias("first"), F.max("draw").alias("last"))
        found: dict[int, list] = {}
        for r in bins.collect():  # at most 2 ** bits rows a pattern
            found.setdefault(r["pattern"], []).append(r)
        for p in list(walks):
            w = walks[p]
            border = None
            for r in sorted(found.get(p, []), key=lambda r: r["bin"]):
                if w["taken"] + r["n"] > w["left"]:
                    border = r
                    break
                w["taken"] += r["n"]
            if border and border["first"] < border["last"]:  # look into the bin
                w |= {"from": border["bin"] << w["shift"], "upto": (border["bin"] + 1) << w["shift"], "shift": max(w["shift"] - bits, 0)}
                continue
            high = border["first"] if border else w["upto"]
            stretches.append((p, w["low"], high, w["left"]))
            left = w["left"] - w["taken"]
            if border is None and w["upto"] == 1 << DRAW_BITS or left <= near * rests[p]:
                del walks[p]
                continue
            w |= {"low": high + (border is not None), "left": left, "from": 0, "upto": 1 << DRAW_BITS, "shift": DRAW_BITS - bits, "taken": 0}
    return stretches


def _facts(docs: DataFrame, members: str, seed: int, column: str) -> list[F.Column]:
    """key (hash of id and text), size, sources and draw of each row."""
    sources = F.col(members) if dict(docs.dtypes)[members].startswith("array") else F.array(members)
    key = F.xxhash64("doc_id", column)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 2)
    return [key.alias("key"), word_count(column).alias("size"), F.array_sort(F.array_distinct(sources)).alias("sources"), draw.alias("draw")]


def _solved(docs: DataFrame, weigh, members: str, seed: int, passes: int, column: str, near: float) -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame], dict, dict]:
    """Rows with their facts; what adds ``_times`` to rows whose facts have a prefix, without moving them; sizes; quotas."""
    spark = docs.sparkSession
    rows = written(docs.select("doc_id", *_facts(docs, members, seed, column)))
    found = rows.groupBy("sources").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise QueryError("too_many_sources", f"more than {MOST_PATTERNS} sets of sources")
    patterns = {tuple(r["sources"]): r["size"] for r in found if r["sources"]}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    quotas = targets(sizes, weigh(names), passes)
    taken = route({p: n for p, n in patterns.items() if n}, {s: round(q) for s, q in quotas.items()}, passes)
    plan, rests = [], {}
    for i, (p, n) in enumerate(sorted(patterns.items(), key=lambda x: str(x[0]))):
        whole, rests[i] = divmod(taken.get(p, 0), n) if n else (0, 0)
        plan.append((i, list(p), whole))
    plan = F.broadcast(spark.createDataFrame(plan, "_pattern int, _members array<string>, _whole long"))  # one row a pattern
    placed = rows.join(plan, rows["sources"].eqNullSafe(plan["_members"])).select(F.col("_pattern").alias("pattern"), "draw", "size")
    stretches = fill(placed, rests, near)
    of = F.broadcast(spark.createDataFrame(stretches, "_of int, _low long, _high long, _most long"))  # a few rows a pattern

    def timed(some: DataFrame, at: str) -> DataFrame:
        draw, size = F.col(f"{at}draw"), F.col(f"{at}size")
        inside = (F.col("_pattern") == F.col("_of")) & (draw >= F.col("_low")) & (draw < F.col("_high")) & (size <= F.col("_most"))
        some = some.join(plan, F.col(f"{at}sources").eqNullSafe(F.col("_members")), "left").join(of, inside, "left")
        times = F.coalesce(F.when(size > 0, F.col("_whole") + F.col("_of").isNotNull().cast("long")), F.lit(0))
        return some.withColumn("_times", times)

    return rows, timed, sizes, quotas


def mix(docs: DataFrame, weigh, members: str = "source", seed: int = 7, passes: int = MAX_PASSES, column: str = "text", near: float = NEAR) -> tuple[DataFrame, dict, dict]:
    """One row per row of ``docs``: doc_id, key (hash of id and text), size, sources, passes taken.

    ``members``: a column with one source or an array of them. ``weigh(sources)`` gives the weights of
    the sorted sources (null last). Returns (rows, sizes, quotas).
    """
    rows, timed, sizes, quotas = _solved(docs, weigh, members, seed, passes, column, near)
    return timed(rows, "").select("doc_id", "key", "size", "sources", F.col("_times").alias("times")), sizes, quotas


def cycle(*weights: int):
    """Weights that repeat along the sorted sources."""
    return lambda names: {s: weights[i % len(weights)] for i, s in enumerate(names)}


def mixed(docs: DataFrame, weigh, members: str = "source", seed: int = 7, passes: int = MAX_PASSES) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as the mix takes it. Texts stay where they are: no shuffle."""
    _, timed, _, _ = _solved(docs, weigh, members, seed, passes, "text", NEAR)
    out = timed(docs.withColumn("_facts", F.struct(*_facts(docs, members, seed, "text"))), "_facts.").where("_times > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*docs.columns)
