"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal updates.

Features of a text are hashed word n-grams: every lower-cased word and every pair of neighbours. Beside
them stand n-grams over two coarser views of the words: the word's shape (runs of letters and digits
become one sign, all else stays) and pairs of shapes, and whether a word equals one of the three before it. A feature's value is its share of the text's features; a score is the logistic
of one sparse dot product with the weights. Training takes a bounded sample of the labelled rows
(``TRAIN_ROWS``, those with the smallest hash); shards of it run the updates of
follow-the-regularised-leader side by side; after each pass their weights and their sums of squared
gradients (the per-coordinate rates) are averaged, and the next pass goes on from these. Two more models,
each of half of the shards, score the other half; a slope and an intercept fitted to these scores (rows
that the model has not seen) are put into the final weights.

Null and empty texts have no feature and score the logistic of the bias. Without any labelled row all
scores are 0.5; with labels of one kind only nothing is stretched. Null labels are ignored; of several labels of one doc_id the mean decides (a tie
counts as 1). Repeated rows score alike; a null doc_id has no label and is not held out. An empty
table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.spark import written
from quern.llm.texts import LOWER, buffers, carried, chunks, extended, mix, rows_of, span_hashes, spared, word_spans

BITS = 18
#: Word, shape, pair of shapes, repetition, pair of words.
VIEWS = 5
TRAIN_ROWS = 24_000
SHARDS = 8
PASSES = 4
SCALE = 8.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.02

_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = ord("a")
_KIND[128:] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("0")
_SOFT = np.zeros(256, bool)
_SOFT[[ord("a"), ord("A"), ord("0")]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of every text, concatenated, and each text's offset: ``VIEWS`` for each word."""
    data, offsets = buffers(texts)
    starts, ends, first = word_spans(data, offsets)
    n, row = len(starts), rows_of(first)
    if not n:
        return np.zeros(0, np.int64), VIEWS * first
    word = span_hashes(LOWER[data], starts, ends)
    kind = _KIND[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~_SOFT[kind[1:]]
    keep[starts] = True
    at = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    shape = span_hashes(kind[keep], at[starts], at[ends])
    before = np.zeros(n, np.uint64)
    again = np.zeros(n, np.uint64)
    same = row[1:] == row[:-1]
    before[1:][same] = shape[:-1][same]
    for k in (3, 2, 1):
        if n > k:
            equal = (word[k:] == word[:-k]) & (row[k:] == row[:-k])
            again[k:][equal] = k
    pair = np.zeros(n, np.uint64)
    pair[1:][same] = word[:-1][same]
    out = np.empty((n, VIEWS), np.uint64)
    out[:, 0] = word
    out[:, 1] = mix(shape + np.uint64(1))
    out[:, 2] = mix(before * np.uint64(31) + shape + np.uint64(2))
    out[:, 3] = mix(again + np.uint64(3))
    out[:, 4] = mix(pair * np.uint64(0x9E3779B97F4A7C15) + word)
    return (out.reshape(-1) >> np.uint64(64 - BITS)).astype(np.int64), VIEWS * first


def scores(index: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic of each text's sparse dot product; the last weight is the bias."""
    total = np.zeros(len(index) + 1)
    np.cumsum(weights[index], out=total[1:])
    mean = (total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1)
    return 1 / (1 + np.exp(-np.clip(SCALE * mean + weights[-1], -30, 30)))


class Ftrl:
    """FTRL-proximal with per-coordinate rates."""

    def __init__(self, start: np.ndarray, squares: np.ndarray):
        self.n = squares.copy()
        # The leader's sums that reproduce the starting weights at these rates.
        self.z = -start * ((BETA + np.sqrt(self.n)) / ALPHA + L2) - np.sign(start) * L1

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        rate = (BETA + np.sqrt(self.n[i])) / ALPHA + L2
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / rate, 0.0)

    def step(self, i: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def train(docs: DataFrame, labels: DataFrame, column: str = "text", label: str = "quality", most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from the labelled rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            index, at = features(batch.column(0))
            rows = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                i, c = np.unique(index[a:b], return_counts=True)
                x = np.append(SCALE * c / max(1, b - a), 1.0).astype("<f4")
                rows.append((np.append(i, 1 << BITS).astype("<u4").tobytes(), x.tobytes()))
            i, x = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.binary()), pa.array(x, pa.binary()), batch.column(1), batch.column(2), batch.column(3)], ["i", "x", "y", "shard", "draw"])

    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    drawn = known.withColumn("draw", F.xxhash64("_id", F.lit(1))).orderBy("draw").limit(most)  # the bounded sample
    drawn = drawn.withColumn("shard", F.pmod("draw", F.lit(SHARDS)).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(column, F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), "_id").select("text", "y", "shard", "draw")
    spark = docs.sparkSession
    sample = written(rows.mapInArrow(spared(count), "i binary, x binary, y double, shard int, draw long"))
    # Three models side by side: without the even shards, without the odd ones, and of all.
    state = np.zeros((3, 2, (1 << BITS) + 1), np.float32)
    for _ in range(PASSES):
        sent = spark.sparkContext.broadcast(state)  # fixed size

        def fit(group: pa.Table) -> pa.Table:
            order = np.lexsort((group.column("x").to_numpy(), group.column("draw").to_numpy()))
            i, x, y = group.column("i").to_pylist(), group.column("x").to_pylist(), group.column("y").to_pylist()
            out = []
            for k in {0, 1, 2} - {group.column("shard")[0].as_py() % 2}:
                model = Ftrl(*sent.value[k].astype(float))  # noqa: B023  (this pass's)
                for r in order.tolist():
                    model.step(np.frombuffer(i[r], "<u4"), np.frombuffer(x[r], "<f4"), y[r])
                out.append((k, model.weights(np.arange((1 << BITS) + 1)).astype("<f4").tobytes(), model.n.astype("<f4").tobytes(), len(y)))
            return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["model", "w", "s", "n"])

        got = sorted(sample.groupBy("shard").applyInArrow(fit, "model int, w binary, s binary, n long").collect(), key=lambda r: (r["model"], bytes(r["w"])))  # two vectors a shard and model
        sent.destroy()
        for k in {r["model"] for r in got}:
            mine = [r for r in got if r["model"] == k]
            for j, c in enumerate("ws"):
                state[k, j] = sum(np.frombuffer(r[c], "<f4").astype(float) * r["n"] for r in mine) / sum(r["n"] for r in mine)
    return calibrated(sample, state[:, 0].astype(float))


def calibrated(sample: DataFrame, weights: np.ndarray) -> np.ndarray:
    """The third model's weights, stretched and moved so that scores are shares: fitted on each row's total under the model that has not seen it."""
    sent = sample.sparkSession.sparkContext.broadcast(weights[:2])  # fixed size

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value[s % 2][np.frombuffer(i, "<u4")] @ np.frombuffer(x, "<f4") for i, x, s in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(3)], ["m", "y"])

    rows = sample.select("i", "x", "shard", "y").mapInArrow(totals, "m double, y double").collect()  # of the bounded sample
    m, y = np.array(sorted((r["m"], r["y"]) for r in rows)).reshape(-1, 2).T
    out = weights[2].copy()
    if len(np.unique(y)) == 2:
        a, b = platt(m, y)
        out *= a
        out[-1] += b
    return out


def platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and intercept of the logistic from totals to labels, by Newton steps; labels are drawn in by a row of each kind."""
    up = y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
    a, b = 1.0, 0.0
    loss = lambda a, b: np.logaddexp(0, a * m + b).sum() - (target * (a * m + b)).sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - target) * m).sum(), (p - target).sum()])
        w = p * (1 - p)
        h = np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]]) + 1e-9 * np.eye(2)
        da, db = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-6 and loss(a - t * da, b - t * db) > loss(a, b):
            t /= 2
        a, b = a - t * da, b - t * db
        if abs(t * da) + abs(t * db) < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def score(docs: DataFrame, weights: np.ndarray, column: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1, higher: label 1 likelier) added."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # fixed size: 2 ** BITS + 1
    rows, schema, place, kept = carried(docs, column, "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(float)
        for batch in chunks(batches, place):
            index, at = features(batch.column(place))
            yield extended(batch, kept, "score double", [pa.array(scores(index, at, w))])

    return rows.mapInArrow(spared(run), schema)
