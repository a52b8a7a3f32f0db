"""Top-k inner-product search of a query set against all vectors, shard by shard.

Vectors are dealt into cells of space (``Space``: nearest centres, or boxes of a kd-tree), and a cell into
shards of bounded size. What a cell can hold for a query is bounded from a summary of its rows, so after
a visit to its own shard a query goes, with its kth score so far, only to the shards of cells that may
still hold better. A shard indexes its rows once and answers the queries that stream by; what is
particular to an index is how far each of its leaves can reach (``Index``).

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without a
``vec_id``, nor empty vectors. Vectors of another length have no inner product, so each length (at most
``LENGTHS``, else the table is refused) is searched on its own. Rows that repeat both ``vec_id`` and
vector are one; rows that share a ``vec_id`` and differ in the vector are candidates (and queries) of
their own. Ties go to the smaller ``vec_id``. A query with fewer candidates gets all; an empty table
gives an empty result. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.llm.spark import tasks, written
from quern.llm.texts import spared

SHARD_ROWS = 4096
BLOCK_QUERIES = 256
LEAF_ROWS = 64
LENGTHS = 16
#: Most cells, and sampled vectors a cell that the cells are laid out by (any layout is right, a good one prunes).
MOST_CELLS = 1024
SAMPLE_PER_CELL = 16


class Index(Protocol):
    """An index over the rows of one shard."""

    order: np.ndarray
    leaves: list[slice]

    def reach(self, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """(queries, leaves): the largest inner product that a leaf is taken to hold."""

    def within(self, queries: np.ndarray, kth: np.ndarray, leaf: int) -> np.ndarray | None:
        """(queries, rows of the leaf): which rows may still beat a query's kth score; None: all."""


class Space(Protocol):
    """Cells of space."""

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""

    def measure(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """(rows, width): what a cell's summary holds the largest of."""

    def reach(self, queries: np.ndarray, kth: np.ndarray, cells: np.ndarray, summary: np.ndarray) -> np.ndarray:
        """(queries, cells): the largest inner product that a cell is taken to hold."""

    def index(self, rows: np.ndarray) -> Index: ...


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), width)


def vectors(table: DataFrame, column: str = "embedding", zero: bool = True, fit: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """vec_id, tag (hash of the vector), d (its length) and v (packed doubles, after ``fit``) of those that take part. ``zero``: do zero vectors?"""
    rows = table.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    rows = rows.where((F.size("x") > 0) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows if zero else rows.where(F.exists("x", lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            flat = np.ascontiguousarray(fit(batch.column(1).values.to_numpy(zero_copy_only=False)), "<f8")
            v = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int32()), pa.array(v, pa.binary())], ["vec_id", "d", "v"])

    packed = rows.mapInArrow(spared(run), "vec_id long, d int, v binary")
    return packed.select("vec_id", F.xxhash64("v").alias("tag"), "d", "v").dropDuplicates(["vec_id", "tag"])


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last in double precision."""
    total = np.zeros(len(x), np.result_type(x, y))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


def integers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same in 64-bit integers."""
    return exact(x.astype(np.int64), y.astype(np.int64))


def found_schema(score: str) -> str:
    return f"query_id long, query_tag long, vec_id long, tag long, score {score}, verified long"


def answer(queries: np.ndarray, own: np.ndarray, kth: np.ndarray, ids: np.ndarray, rows: np.ndarray, index: Index, k: int, slack: float, product=exact) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of at most ``k`` best rows for each query that reach its kth score, and how many rows each query verified.

    Leaves are visited in the order of their best reach; a leaf only sees queries whose current kth
    score it can still reach. ``slack`` is what matrix products may be off, in parts of the norms.
    ``own`` and ``ids``: (vec_id, tag) of queries and rows.
    """
    reach = index.reach(queries, kth)
    kth = kth.copy()
    give = slack * np.linalg.norm(queries, axis=1) * (np.linalg.norm(rows, axis=1).max() if len(rows) else 0)
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, product(rows[:0], rows[:0]).dtype)]
    verified = np.zeros(len(queries), np.int64)

    def visit(leaf: int, q: np.ndarray) -> None:
        here = index.order[index.leaves[leaf]]
        open_ = index.within(queries[q], kth[q], leaf)
        verified[q] += len(here) if open_ is None else open_.sum(axis=1)
        near = queries[q] @ rows[here].T  # one product of matrices costs less than gathering the open pairs
        ok = (near >= (kth[q] - give[q])[:, None]) & ((own[q][:, None, :] != ids[here][None, :, :]).any(axis=2))
        a, b = np.nonzero(ok if open_ is None else ok & open_)
        if not len(a):
            return
        new = [q[a], here[b], product(queries[q[a]], rows[here[b]])]
        touched = np.isin(best[0], q)
        who, row, score = (np.concatenate([x[touched], y]) for x, y in zip(best, new, strict=True))
        order = np.lexsort((ids[row, 1], ids[row, 0], -score, who))
        who, row, score = who[order], row[order], score[order]
        at = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        rank = np.arange(len(who)) - np.repeat(at, np.diff(np.append(at, len(who))))
        full = rank == k - 1
        kth[who[full]] = np.maximum(kth[who[full]], score[full])
        keep = (rank < k) & (score >= kth[who])
        best[:] = [np.concatenate([x[~touched], y[keep]]) for x, y in zip(best, (who, row, score), strict=True)]

    if len(rows):
        first = reach.argmax(axis=1)  # every query starts where it may find most
        for leaf in np.unique(first).tolist():
            visit(leaf, np.flatnonzero(first == leaf))
        for leaf in np.argsort(-reach.max(axis=0), kind="stable").tolist():
            q = np.flatnonzero((reach[:, leaf] >= kth - give) & (first != leaf))
            if len(q):
                visit(leaf, q)
    return *best, verified


def search(table: DataFrame, every: int, k: int, lay: Callable[[np.ndarray, int], Space], slack: float = 0.0, score: str = "double") -> DataFrame:
    """query_id, rank, vec_id, score, verified (rows that the query was scored against) of the ``k`` best rows for each query.

    Queries are the rows of ``vectors`` whose ``vec_id`` is divisible by ``every``; ``lay`` makes the cells from a sample.
    ``score``: double, or long for vectors of integers.
    """
    table = written(table)
    lengths = [r["d"] for r in table.select("d").distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise QueryError("too_many_lengths", f"vectors of more than {LENGTHS} lengths")
    found = [_search(table.where(F.col("d") == d).drop("d"), d, every, k, lay, slack, score) for d in sorted(lengths)]
    out = found[0] if found else table.sparkSession.createDataFrame([], found_schema(score))
    for more in found[1:]:
        out = out.unionByName(more)
    asked = Window.partitionBy("query_id", "query_tag")
    best = asked.orderBy(F.desc("score"), "vec_id", "tag")
    ranked = out.withColumn("verified", F.sum("verified").over(asked)).where("vec_id is not null").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")


def _search(table: DataFrame, width: int, every: int, k: int, lay: Callable[[np.ndarray, int], Space], slack: float, score: str) -> DataFrame:
    spark = table.sparkSession
    product, kind_of = (integers, pa.int64()) if score == "long" else (exact, pa.float64())
    schema = found_schema(score)
    n = table.count()
    n_cells = min(max(1, n // SHARD_ROWS), MOST_CELLS)
    drawn = table.where(F.pmod(F.xxhash64("vec_id", "tag", F.lit(3)), F.lit(n)) < SAMPLE_PER_CELL * n_cells).select("vec_id", "v").collect()  # bounded: see the constants
    sample = np.frombuffer(b"".join(r["v"] for r in sorted(drawn)), "<f8").reshape(-1, width)
    space = lay(sample, n_cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(space.assign(matrix(batch.column(2), width)), pa.int32())], [*batch.schema.names, "cell"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            cells = batch.column(1).to_numpy()
            rows = space.measure(matrix(batch.column(0), width), cells)
            for c in np.unique(cells).tolist():
                mine = rows[cells == c]
                most[c] = np.maximum(most.get(c, -np.inf), mine.max(axis=0))
                count[c] = count.get(c, 0) + len(mine)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(most.keys(), pa.int32()), "n": pa.array(count.values(), pa.int64()), "most": pa.array(list(most.values()), pa.list_(pa.float64()))})

    placed = written(table.mapInArrow(spared(place), "vec_id long, tag long, v binary, cell int"))
    each = placed.select("v", "cell").mapInArrow(spared(measure), "cell int, n long, most array<double>")
    spread = each.select("cell", "n", F.posexplode("most").alias("i", "x")).groupBy("cell", "i").agg(F.max("x").alias("x"), F.sum("n").alias("n"))
    summary = sorted(spread.groupBy("cell").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("most")).collect())  # one row a cell
    cells = np.array([r["cell"] for r in summary], np.int64)
    parts = np.array([-(-r["n"] // SHARD_ROWS) for r in summary], np.int64)
    bounds = np.array([[m["x"] for m in r["most"]] for r in summary], float)
    deal = F.broadcast(spark.createDataFrame([(int(c), int(p)) for c, p in zip(cells, parts, strict=True)], "cell int, parts int"))  # one row a cell

    shard = F.pmod(F.xxhash64("vec_id", "tag"), F.col("parts")).cast("int")
    rows = placed.join(deal, "cell").withColumn("part", shard).drop("parts")
    asked = rows.where(F.col("vec_id") % every == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, raw, held, waiting = None, [], [], None, []

        def reply() -> pa.RecordBatch:
            nonlocal held
            if held is None:
                m = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), width)
                held = np.array(ids, np.int64).reshape(-1, 2), m, space.index(m)
            names, m, index = held
            own = np.array([w[:2] for w in waiting], np.int64)
            q = np.frombuffer(b"".join(w[2] for w in waiting), "<f8").reshape(len(waiting), width)
            who, row, value, verified = answer(q, own, np.array([w[3] for w in waiting], float), names, m, index, k, slack, product)
            waiting.clear()
            blank = pa.nulls(len(own), pa.int64())
            columns = [
                [pa.array(own[who, 0]), pa.array(own[:, 0])],
                [pa.array(own[who, 1]), pa.array(own[:, 1])],
                [pa.array(names[row, 0]), blank],
                [pa.array(names[row, 1]), blank],
                [pa.array(value, kind_of), pa.nulls(len(own), kind_of)],
                [pa.nulls(len(who), pa.int64()), pa.array(verified)],
            ]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], [f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            for cell, part, kind, vec_id, tag, v, kth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, part) != at:
                    if waiting:
                        yield reply()
                    at, ids, raw, held = (cell, part), [], [], None
                if kind == 0:
                    ids.append((vec_id, tag))
                    raw.append(v)
                elif raw:
                    waiting.append((vec_id, tag, v, kth))
                    if len(waiting) == BLOCK_QUERIES:
                        yield reply()
        if waiting:
            yield reply()

    columns = ["cell", "part", "kind", "vec_id", "tag", "v", "kth"]
    stock = rows.withColumns({"kind": F.lit(0), "kth": F.lit(None).cast("double")}).select(columns)

    def ask(queries: DataFrame) -> DataFrame:
        both = stock.unionByName(queries.withColumn("kind", F.lit(1)).select(columns))
        n_parts = min(int(parts.sum()), max(4 * tasks(spark), n // (16 * SHARD_ROWS)))
        return both.repartition(max(1, n_parts), "cell", "part").sortWithinPartitions("cell", "part", "kind", "vec_id", "tag").mapInArrow(spared(run), schema)

    found = written(ask(asked.withColumn("kth", F.lit(float("-inf")))))
    if parts.sum() <= 1:
        return found
    known = found.where("vec_id is not null").groupBy("query_id", "query_tag").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    known = known.select(F.col("query_id").alias("vec_id"), F.col("query_tag").alias("tag"), F.when(F.col("n") >= k, F.col("low").cast("double")).alias("low"))
    again = asked.join(known, ["vec_id", "tag"], "left").select("vec_id", "tag", "v", F.coalesce("low", F.lit(float("-inf"))).alias("kth"), "cell", "part")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, kth = matrix(batch.column(2), width), batch.column(3).to_numpy()
            open_ = space.reach(q, kth, cells, bounds) >= kth[:, None]
            home, part = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            to = [[(int(cells[c]) << 32) + p for c in np.flatnonzero(o).tolist() for p in range(parts[c]) if (cells[c], p) != (h, own)] for o, h, own in zip(open_, home, part, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(to, pa.list_(pa.int64()))], ["vec_id", "tag", "v", "kth", "to"])

    sent = again.mapInArrow(spared(visits), "vec_id long, tag long, v binary, kth double, to array<long>").select("vec_id", "tag", "v", "kth", F.explode("to").alias("to"))
    sent = sent.withColumns({"cell": F.shiftright("to", 32).cast("int"), "part": F.col("to").bitwiseAND(F.expr("4294967295L")).cast("int")})
    return found.unionByName(ask(sent))
