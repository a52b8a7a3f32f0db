"""Exchange of fingerprints in blocks: which of my hashes does any other block hold?

A task gathers the hashes of its rows into blocks of bounded size. A block drops repeats (a hash that
a third of all rows hold leaves a block once), sorts what is left and sends one compressed blob to
each hash range. A range sees every block's part, decides, and answers each block with one blob.
Blocks and ranges are bounded whatever the data, and one key never fills a range.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quern.llm.spark import tasks

#: Hashes that a block gathers, and bytes of text that a hash range answers for.
BLOCK_HASHES = 1_000_000
RANGE_BYTES = 8 << 20
LEAST_RANGES = 64
MANY = 0xFFFFFFFF
BLOBS = "range int, block long, payload binary"
_blobs = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])


def ranges(spark: SparkSession, text_bytes: int) -> int:
    """Hash ranges for a corpus of so many bytes."""
    return max(LEAST_RANGES, 2 * tasks(spark), -(-text_bytes // RANGE_BYTES))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, byte planes apart so that slow-moving bytes vanish."""
    head = [struct.pack("<B", len(arrays))]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, out, at = raw[0], [], 1 + 10 * raw[0]
    for k in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, 1 + 10 * k)
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(size))
        at += size * dtype.itemsize
    return out


def range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash range of each hash: equal slices of the hash space, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (f.type for f in _blobs), strict=True)], schema=_blobs)


def block_id(n: int) -> int:
    return TaskContext.get().partitionId() << 24 | n


def home(block: int, n: int) -> int:
    """The range that keeps a block's own rows: evenly over all ranges, whatever power of two divides their number."""
    return (block * 0x9E3779B97F4A7C15 >> 40 & 0xFFFFFF) % n


def sliced(hashes: np.ndarray, n: int, *others: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Parts of sorted hashes (and what stands beside them) by range; empty ones are left out."""
    if not len(hashes):
        return
    at = range_of(hashes, n)
    cut = np.flatnonzero(np.diff(at)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
        yield int(at[a]), [hashes[a:b], *(o[a:b] for o in others)]


def local(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order with their owner (``MANY`` for those that occur again), and each occurrence of the latter."""
    order = np.argsort(hashes, kind="stable")
    h, o = hashes[order], owners[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(h)))
    many = np.repeat(count > 1, count)
    return h[start], np.where(count > 1, MANY, o[start]).astype(np.uint32), h[many], o[many]


def by_group(df: DataFrame, key: str, fn: Callable[[list, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``fn(blocks, payloads)`` for every value of ``key`` (``range`` or ``block``)."""
    back = "block" if key == "range" else "range"

    def run(group: pa.Table) -> pa.Table:
        parts = list(fn(group.column(back).to_pylist(), group.column("payload").to_pylist()))
        return pa.Table.from_batches(parts)

    return df.groupBy(key).applyInArrow(run, schema)
