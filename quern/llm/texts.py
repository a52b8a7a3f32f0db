"""Vectorised text primitives shared by the operators: Arrow chunking and word fingerprints.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.spark import bounded

CHUNK_BYTES = 2 << 20
#: Bytes whose spans are hashed at once; spans longer than ``LONG_BYTES`` are hashed by BLAKE2.
PIECE_BYTES, LONG_BYTES = 1 << 18, 64
_BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(batches: Iterable[pa.RecordBatch], column: str | int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds at most ``most`` bytes (one longer row stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = column if isinstance(column, int) else batch.schema.get_field_index(column)
        _, offsets = buffers(batch.column(at))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def spared(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving freed memory back to the system when a partition ends: the worker lives on and others need the room."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
            if trim:
                trim(0)

    return wrapped


def carried(docs: DataFrame, column: str, added: str) -> tuple[DataFrame, str, int, int]:
    """Rows for a batch function that adds columns (``added``: their DDL), with one copy of the text.

    Gives the rows, the schema of the result, the place of the text and how many columns are kept;
    columns of ``docs`` with the names of added ones go.
    """
    bounded(docs.sparkSession)
    base = docs.drop(*(a.split()[0] for a in added.split(", ")))
    rows = base if column in base.columns else docs.select(*base.columns, F.col(column).alias("_text"))
    at = base.columns.index(column) if column in base.columns else len(base.columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), added])
    return rows, schema, at, len(base.columns)


def extended(batch: pa.RecordBatch, kept: int, added: str, columns: list[pa.Array]) -> pa.RecordBatch:
    """The first ``kept`` columns of a batch and the added ones."""
    names = [a.split()[0] for a in added.split(", ")]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), *columns], [*batch.schema.names[:kept], *names])


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; null rows are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    _, where, data = array.buffers()
    if where is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (one more at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: A span of 0 to 8 bytes, as a mask of a little-endian word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ROUNDS = mix(np.arange(1, 9, dtype=np.uint64))


def _absorbed(h: list[np.ndarray], w: list[np.ndarray]) -> list[np.ndarray]:
    """The state after 16 more bytes: a keyless permutation of both, with what went in added again, so that it can't be run backwards."""
    a, b = h[0] ^ w[0], h[1] ^ w[1]
    for k in _ROUNDS[:4]:
        a, b = b, a ^ mix(b + k)
    return [a ^ w[0] ^ mix(h[1] + _ROUNDS[4]), b ^ w[1] ^ mix(h[0] + _ROUNDS[5])]


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints of every byte span (in ascending order): 16 bytes at a time, BLAKE2 for spans over ``LONG_BYTES``."""
    out = np.empty((len(starts), 2), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE_BYTES)))
        s, n = starts[at:end] - starts[at], (ends - starts)[at:end]
        long = np.flatnonzero(n > LONG_BYTES)
        last = int((s + np.minimum(n, LONG_BYTES)).max())
        piece = np.zeros(last + 24, np.uint8)
        piece[:last] = data[starts[at] : starts[at] + last]
        word = np.ndarray((len(piece) - 7,), np.uint64, piece, strides=(1,))  # from every byte on
        size = n.astype(np.uint64)
        h = [mix(size + _ROUNDS[6]), mix(size + _ROUNDS[7])]
        for done in range(0, LONG_BYTES, 16):
            some = np.flatnonzero(n > done) if done else np.arange(len(n))
            if not len(some):
                break
            here, left = s[some] + done, n[some] - done
            w = [word[np.minimum(here + k, len(word) - 1)] & _MASKS[np.clip(left - k, 0, 8)] for k in (0, 8)]
            new = _absorbed([x[some] for x in h], w)
            for x, y in zip(h, new, strict=True):
                x[some] = y
        out[at:end, 0], out[at:end, 1] = h
        for i in (at + long).tolist():
            out[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].data, digest_size=16).digest(), "<u8")
        at = end
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte spans in ascending order."""
    return span_digests(data, starts, ends)[:, 0]


def word_digests(array: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Both fingerprints of the words of a text column, and the index of each row's first word (one more at the end)."""
    data, offsets = buffers(array)
    starts, ends, first = word_spans(data, offsets)
    return span_digests(LOWER[data] if lower else data, starts, ends), first


def word_hashes(array: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of a text column and the index of each row's first word (one more at the end)."""
    words, first = word_digests(array, lower)
    return words[:, 0], first


def distinct(data: np.ndarray, edges: np.ndarray, text: bool = True) -> tuple[pa.Array, pa.Array]:
    """The distinct spans between consecutive ``edges`` (the first is 0, the last the length), as strings or bytes, and which of them each span is."""
    found = column_of(data, edges, text).dictionary_encode()
    return found.dictionary, found.indices


def listed(column: pa.Array) -> list:
    """The values of a column of strings or bytes, many times faster than by ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def column_of(raw: np.ndarray, edges: np.ndarray, text: bool = False) -> pa.Array:
    """A binary or string column over one buffer, cut at ``edges``."""
    wide = edges[-1] >= 1 << 31
    kind = (pa.large_string if wide else pa.string) if text else (pa.large_binary if wide else pa.binary)
    where = pa.py_buffer(edges.astype(np.int64 if wide else np.int32))
    return pa.Array.from_buffers(kind(), len(edges) - 1, [None, where, pa.py_buffer(np.ascontiguousarray(raw))])


def dealt(parts: pa.Array, codes: pa.Array | np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``parts`` (large_binary) that ``codes`` name, one after another, and where those of each row start (``first``: its first code)."""
    raw, ends = buffers(parts.take(codes if isinstance(codes, pa.Array) else pa.array(codes)))
    return raw, ends[first]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of every ``size`` consecutive entries of ``words`` (row borders are the caller's business)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + words[k : k + n]
    return mix(out)


def rows_of(first: np.ndarray) -> np.ndarray:
    """For each word the row that it stands in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... for each i, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.cumsum(n) - n
    out[at] = s
    out[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)
