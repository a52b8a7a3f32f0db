"""Document fingerprints: quartile digests of hashed byte triplets, and a bounded score of how alike two digests are.

Every window of five bytes gives six triplets (its first byte with two of the others). Each is hashed by tables of its own
into one of ``BUCKETS`` buckets; a bucket's code tells in which quarter of the text's buckets its count lies (2 bits). The
fingerprint is the hexadecimal form of a logarithm of the text's bytes and these codes. Texts are padded by four zero
bytes, so that short ones have triplets; an empty text has none.

The difference of two fingerprints is the sum of the steps between their codes plus, at an eighth of the weight, the
steps (eight at most count) between their lengths; over the largest it could be with these codes it is at most 1, and
likeness is 1 less that. Equal texts have equal fingerprints and likeness 1.

``with_next`` measures it: every document against the next one by doc_id and against an edit of itself. Rows with equal
doc_ids follow by a hash of their text; null doc_ids come first; after the last row comes the first. Null texts are
empty. An empty table gives an empty result; columns other than doc_id and the text take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.spark import bounded, written
from quern.llm.texts import carried, chunks, extended, spared

BUCKETS = 256
#: The other two bytes of each triplet of a window.
OTHERS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
PAD = b"\0" * 4
#: Bytes counted at once, and texts whose counts are held at once.
PIECE_BYTES, ROWS = 1 << 20, 2048
LENGTH_STEPS, MOST_STEPS, LENGTH_SHARE = 8, 8, 8
_TABLES = np.random.RandomState(5).randint(0, BUCKETS, (3, len(OTHERS), 256)).astype(np.uint8)
_SHIFTS = np.arange(0, 8, 2, dtype=np.uint8)


def _count(data: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Triplets by row and bucket; bytes of row ``rows`` start none."""
    total = np.zeros((rows + 1) * BUCKETS, np.int64)
    n = len(data) - len(PAD)
    base = row[:n] * BUCKETS
    for k, (i, j) in enumerate(OTHERS):
        bucket = _TABLES[0, k][data[:n]] ^ _TABLES[1, k][data[i : n + i]] ^ _TABLES[2, k][data[j : n + j]]
        total += np.bincount(base + bucket, minlength=len(total))
    return total.reshape(rows + 1, BUCKETS)[:rows]


def counts(texts: list[bytes]) -> np.ndarray:
    """Counts of the buckets, a row a text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if sizes.sum() <= PIECE_BYTES:
        parts = np.repeat(np.stack([np.arange(len(texts)), np.full(len(texts), len(texts))], axis=1).reshape(-1), np.stack([sizes, np.full(len(texts), len(PAD))], axis=1).reshape(-1))
        return _count(np.frombuffer(PAD.join([*texts, b""]), np.uint8), parts, len(texts)) if len(texts) else np.zeros((0, BUCKETS), np.int64)
    out = np.zeros((len(texts), BUCKETS), np.int64)
    for r, text in enumerate(texts):
        for at in range(0, len(text), PIECE_BYTES):
            piece = text[at : at + PIECE_BYTES + len(PAD)]
            n = min(len(piece), PIECE_BYTES)
            piece += PAD[: n + len(PAD) - len(piece)]
            out[r] += _count(np.frombuffer(piece, np.uint8), np.zeros(len(piece), np.int64), 1)[0]
    return out


def digests(texts: list[str]) -> np.ndarray:
    """A row of bytes a text: length step, then the buckets' quarters."""
    raw = [t.encode() for t in texts]
    out = np.empty((len(raw), 1 + BUCKETS), np.uint8)
    out[:, 0] = np.round(LENGTH_STEPS * np.log2(np.array([len(t) for t in raw], float) + 1))
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and end - at < ROWS and (end == at or size + len(raw[end]) + len(PAD) <= PIECE_BYTES):
            size += len(raw[end]) + len(PAD)
            end += 1
        found = counts(raw[at:end])
        marks = np.partition(found, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
        out[at:end, 1:] = sum((found > marks[:, [q * BUCKETS // 4 - 1]]).astype(np.uint8) for q in (1, 2, 3))
        at = end
    return out


def packed(rows: np.ndarray) -> list[str]:
    """Fingerprints of digests: hexadecimal, four buckets a byte."""
    codes = (rows[:, 1:].reshape(len(rows), -1, 4) << _SHIFTS).sum(axis=2, dtype=np.uint8)
    return [bytes(r).hex() for r in np.concatenate([rows[:, :1], codes], axis=1)]


def unpacked(fingerprints: list[str]) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), 1 + BUCKETS // 4)
    return np.concatenate([raw[:, :1], (raw[:, 1:, None] >> _SHIFTS & 3).reshape(len(raw), -1)], axis=1)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness (0 to 1) of digests, row by row."""
    x, y = a[:, 1:].astype(np.int64), b[:, 1:].astype(np.int64)
    most = np.maximum(x, y).sum(axis=1)
    steps = np.minimum(np.abs(a[:, 0].astype(np.int64) - b[:, 0]), MOST_STEPS)
    apart = LENGTH_SHARE * MOST_STEPS * np.abs(x - y).sum(axis=1) + most * steps
    return 1 - apart / np.maximum((LENGTH_SHARE + 1) * MOST_STEPS * most, 1)


def fingerprint(docs: DataFrame, column: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``fingerprint`` added."""
    rows, schema, place, kept = carried(docs, column, "fingerprint string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, place):
            yield extended(batch, kept, "fingerprint string", [pa.array(packed(digests([t or "" for t in batch.column(place).to_pylist()])), pa.string())])

    return rows.mapInArrow(spared(run), schema)


def compared(rows: DataFrame, a: str, b: str, added: str = "likeness") -> DataFrame:
    """Every row with the likeness of two fingerprint columns added; null where one is null."""
    kept = rows.drop(added)

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        there = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        if there.any():
            out[there] = alike(unpacked(x[there].tolist()), unpacked(y[there].tolist()))
        return pd.Series(out).where(pd.Series(there), None)

    return kept.withColumn(added, run(F.col(a), F.col(b)))


_NEXT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """The last half of ``text``, in code points, replaced by the first as many of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _measured(ids: list, texts: list[str], after: list[str], own: np.ndarray, theirs: np.ndarray) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, after, strict=True)]
    new = digests(changed)
    shas = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(shas, pa.string()), pa.array(packed(own), pa.string()), pa.array(packed(new), pa.string()), pa.array(alike(own, new)), pa.array(alike(own, theirs))]


def with_next(docs: DataFrame, column: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edit, and their likeness, and that to the next document's.

    One shuffle deals the texts by ranges of doc_id. A task knows the successor of each of its rows but the last; that one,
    and the first row of the following range, are written beside the results and meet by the number of the range.
    """
    names = [c.split()[0] for c in _NEXT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, last = TaskContext.get().partitionId(), None

        def out(columns: list[pa.Array], head: str | None, tail: str | None) -> pa.RecordBatch:
            n = len(columns[0])
            marks = [pa.array([me] * n, pa.int32()), pa.array([head] + [None] * (n - 1), pa.string()), pa.array([None] * (n - 1) + [tail], pa.string())]
            return pa.RecordBatch.from_arrays(columns + marks, [*names, "part", "head", "tail"])

        head = None
        for batch in chunks(batches, 1):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = digests(texts)
            if last is None:
                head = texts[0]
            else:
                ids, texts, own = [last[0], *ids], [last[1], *texts], np.concatenate([last[2], own])
            if len(ids) > 1:
                yield out(_measured(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:]), head, None)
                head = None
            last = ids[-1], texts[-1], own[-1:]
        if last:
            bare = [pa.array([last[0]], pa.int64()), pa.array([len(last[1])], pa.int64()), *(pa.array([x], pa.string()) for x in (None, packed(last[2])[0], None)), *[pa.array([None], pa.float64())] * 2]
            yield out(bare, head, last[1])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, PIECE_BYTES):
            ids, texts, after = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(_measured(ids, texts, after, digests(texts), digests(after)), names)

    bounded(docs.sparkSession)
    text = F.coalesce(F.col(column), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    order = ["doc_id", "_tie", "_row"]  # the row's number only spreads rows that are equal
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = written(dealt.mapInArrow(spared(run), f"{_NEXT}, part int, head string, tail string"))
    parts = found.where("tail is not null").select("part")  # one row a range
    w = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(w), F.first("part").over(w)).alias("after"))
    heads = found.where("head is not null").select(F.col("part").alias("after"), "head")
    tails = found.where("tail is not null").select("part", "doc_id", "tail").join(after, "part").join(heads, "after")
    ends = tails.select("doc_id", "tail", "head").mapInArrow(spared(join_up), _NEXT)
    return found.where("tail is null").select(*names).unionByName(ends)
