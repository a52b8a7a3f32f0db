"""Exact removal of long repeated passages, found by recompression.

Rounds of recompression name adjacent pairs of symbols: a hash of a symbol says whether it may stand
left or right in a pair, and a pair's name is made of its parts' names, so equal text gets equal names
in every task of the corpus, and no round has to exchange them. After ``LEVELS`` rounds a border between
symbols depends on at most ``REACH`` words to each side, and a symbol spans at most ``SPAN`` words. The
last round names phrases: the fewest symbols from a border on that span ``PHRASE`` words. Every window of
``WINDOW`` words holds such a phrase, which all of its copies share at the same offset. Runs of one
symbol are not merged (a window may cut a run anywhere), so their inner borders stay, and a run is named
as the sequence of its symbol.

The names of phrases, the highest symbols, are exchanged: a window whose first phrase occurs once in the
corpus cannot repeat. The windows of shared phrases are then verified by fingerprints of all their words
(80 bits, of two independent hashes a word), and every occurrence but the earliest (smallest doc_id, then start) is removed, wherever it
stands.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null, empty and short texts (under one window) lose
nothing; their words are still joined by single spaces. Rows of one doc_id with different texts are
ordered by a hash of the text; rows that repeat both are one document and get the same result. A null
doc_id counts as the smallest. An empty table gives an empty result. Input columns other than those
named are kept by ``dedup_text`` and take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.llm import blocks
from quern.llm.spark import octets, written
from quern.llm.texts import carried, chunks, extended, mix, rows_of, spared, word_digests, word_hashes
from quern.sources.durable import BROADCAST_BYTES

WINDOW = 20
LEVELS = 2
#: Words to each side that decide a border: 1 + 2 for two rounds; most words of a symbol; least words of a phrase.
REACH = 3
SPAN = 4
PHRASE = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = -(1 << 63)


def symbols(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and names of the symbols after all rounds; ``first``: where each row's words start (one more at the end)."""
    name, start = words, np.arange(len(words))
    row = rows_of(first)
    for level in range(LEVELS):
        right = (name >> np.uint64(17 + level)) & np.uint64(1) == 1
        at = np.flatnonzero(~right[:-1] & right[1:] & (row[start[:-1]] == row[start[1:]]))
        name = name.copy()
        name[at] = mix(name[at] * _BASE + name[at + 1] + np.uint64(level))
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, start = name[keep], start[keep]
    return start, name


def borders(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the symbols of the last round start."""
    return symbols(words, first)[0]


def phrases(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and names of all phrases whose borders are decided inside their row."""
    start, name = symbols(words, first)
    ends = np.append(start, len(words))
    to = np.searchsorted(ends, start + PHRASE)
    row = np.searchsorted(first, start, side="right") - 1
    last = ends[np.minimum(to, len(start))]
    fit = np.flatnonzero((start - REACH >= first[row]) & (start + PHRASE <= last) & (last + REACH <= first[row + 1]))
    out = np.zeros(len(fit), np.uint64)
    for k in range(PHRASE):  # a phrase has as many symbols at most
        more = fit + k < to[fit]
        out[more] = mix(out[more] * _BASE + name[fit[more] + k])
    return start[fit], out


def around(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the ``size`` words from each position."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * _BASE + words[at + k]
    return mix(out)


def _keyed(docs: DataFrame, column: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("id"), F.xxhash64(column).alias("tie"), F.col(column).alias("text"))


def shared_names(docs: DataFrame, n_ranges: int) -> DataFrame:
    """id, tie, marks (low 16 bits of the names of its phrases that occur elsewhere too)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ties, parts, owners, number, total = [], [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            h, owner, again, who = blocks.local(np.concatenate(parts), np.concatenate(owners))
            me = blocks.block_id(number)
            rows = [(r, me, b"e" + blocks.pack(x >> np.uint64(16), (x & np.uint64(0xFFFF)).astype(np.uint16), o)) for r, (x, o) in blocks.sliced(h, n_ranges, owner)]
            rows.append((blocks.home(me, n_ranges), me, b"d" + blocks.pack(np.array(ids, np.int64), np.array(ties, np.int64), (again & np.uint64(0xFFFF)).astype(np.uint16), who)))
            return blocks.blobs(rows)

        for batch in chunks(batches, "text"):
            words, first = word_hashes(batch.column(2))
            start, name = phrases(words, first)
            parts.append(name)
            owners.append((np.searchsorted(first, start, side="right") - 1 + len(ids)).astype(np.uint32))
            ids += batch.column(0).to_pylist()
            ties += batch.column(1).to_pylist()
            total += len(start)
            if total > blocks.BLOCK_HASHES:
                yield out()
                ids, ties, parts, owners, number, total = [], [], [], [], number + 1, 0
        if ids:
            yield out()

    def answer(block: list, payload: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = [(0, b, x) for b, x in zip(block, payload, strict=True) if x[:1] == b"d"]
        entries = [(b, blocks.unpack(x[1:])) for b, x in zip(block, payload, strict=True) if x[:1] == b"e"]
        if entries:
            # A name met again in its own block is known there; it only has to be seen by the others.
            h = np.concatenate([e[0] << np.uint64(16) | e[1] for _, e in entries])
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            hit = np.zeros(len(h), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            at = 0
            for b, (_, low, owner) in entries:
                mine = hit[at : at + len(low)] & (owner != blocks.MANY)
                at += len(low)
                if mine.any():
                    rows.append((0, b, b"c" + blocks.pack(low[mine], owner[mine])))
        yield blocks.blobs(rows)

    def gather(_: list, payload: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, ties, low, who = next(blocks.unpack(x[1:]) for x in payload if x[:1] == b"d")
        found = [(low, who), *(blocks.unpack(x[1:]) for x in payload if x[:1] == b"c")]
        low, who = (np.concatenate(c) for c in zip(*found, strict=True))
        pair = np.unique(who.astype(np.uint64) << np.uint64(16) | low)
        who = (pair >> np.uint64(16)).astype(np.int64)
        docs, at = np.unique(who, return_index=True)
        marks = [m.tobytes() for m in np.split((pair & np.uint64(0xFFFF)).astype("<u2"), at[1:])] if len(docs) else []
        yield pa.RecordBatch.from_arrays([pa.array(ids[docs]), pa.array(ties[docs]), pa.array(marks, pa.binary())], ["id", "tie", "marks"])

    sent = docs.mapInArrow(spared(send), blocks.BLOBS)
    return blocks.by_group(blocks.by_group(sent, "range", answer, blocks.BLOBS), "block", gather, "id long, tie long, marks binary")


def later_windows(texts: DataFrame, n_ranges: int, window: int = WINDOW) -> DataFrame:
    """id, tie, starts (of windows that also start earlier), from (id, tie, text, marks)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, number, total = [], 0, 0

        def out() -> pa.RecordBatch:
            h, more, ids, ties, starts = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((starts, ties, ids, more, h))
            h, more, ids, ties, starts = h[order], more[order], ids[order], ties[order], starts[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = (ids != ids[lead]) | (ties != ties[lead]) | (starts != starts[lead])
            me = blocks.block_id(number)
            rows = [(r, me, b"e" + blocks.pack(*x)) for r, (y, z) in blocks.sliced(h[new], n_ranges, np.flatnonzero(new)) for x in [(y, more[z], ids[z], ties[z], starts[z])]]
            rows.append((blocks.home(me, n_ranges), me, b"d" + blocks.pack(ids[late], ties[late], starts[late])))
            return blocks.blobs(rows)

        for batch in chunks(batches, "text"):
            digests, first = word_digests(batch.column(2))
            words, other = digests[:, 0], digests[:, 1]
            start, name = phrases(words, first)
            row = np.searchsorted(first, start, side="right") - 1
            marks = [np.frombuffer(m, "<u2").astype(np.uint64) | np.uint64(i << 16) for i, m in enumerate(batch.column(3).to_pylist()) if m]
            marks = np.concatenate(marks) if marks else np.zeros(0, np.uint64)
            mine = row.astype(np.uint64) << np.uint64(16) | name & np.uint64(0xFFFF)
            known = np.isin(mine, marks)
            s = np.arange(len(words))
            s = s[s + window <= first[1:][rows_of(first)]]
            at = np.searchsorted(start, s + REACH)  # the first phrase of each window
            s = s[known[at]] if len(s) else s
            where = np.searchsorted(first, s, side="right") - 1
            ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            more = (around(other, s, window) >> np.uint64(48)).astype(np.uint16)
            parts.append((around(words, s, window), more, ids[where], ties[where], (s - first[where]).astype(np.uint32)))
            total += len(s)
            if total > blocks.BLOCK_HASHES:
                yield out()
                parts, number, total = [], number + 1, 0
        if parts:
            yield out()

    def split(ids: np.ndarray, ties: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        slot = (mix(ids.view(np.uint64) ^ ties.view(np.uint64)) % np.uint64(n_ranges)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        cut = np.flatnonzero(np.diff(slot[order])) + 1
        for part in np.split(order, cut) if len(order) else []:
            yield 0, int(slot[part[0]]), blocks.pack(ids[part], ties[part], starts[part])

    def answer(_: list, payload: list[bytes]) -> Iterator[pa.RecordBatch]:
        late = [blocks.unpack(x[1:]) for x in payload if x[:1] == b"d"]
        entries = [blocks.unpack(x[1:]) for x in payload if x[:1] == b"e"]
        if entries:
            h, more, ids, ties, starts = (np.concatenate(c) for c in zip(*entries, strict=True))
            order = np.lexsort((starts, ties, ids, more, h))
            h, more, ids, ties, starts = h[order], more[order], ids[order], ties[order], starts[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            x = (ids != ids[lead]) | (ties != ties[lead]) | (starts != starts[lead])
            late.append([ids[x], ties[x], starts[x]])
        yield blocks.blobs([row for part in late for row in split(*part)])

    def gather(_: list, payload: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, ties, starts = (np.concatenate(c) for c in zip(*map(blocks.unpack, payload), strict=True))
        order = np.lexsort((starts, ties, ids))
        ids, ties, starts = ids[order], ties[order], starts[order]
        at = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])))
        packed = [np.unique(x).astype("<u4").tobytes() for x in np.split(starts, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ties[at]), pa.array(packed, pa.binary())], ["id", "tie", "starts"])

    sent = texts.select("id", "tie", "text", "marks").mapInArrow(spared(send), blocks.BLOBS)
    return blocks.by_group(blocks.by_group(sent, "range", answer, blocks.BLOBS), "block", gather, "id long, tie long, starts binary")


def repeats(docs: DataFrame, column: str = "text", window: int = WINDOW) -> DataFrame:
    """id, tie, starts: for each document the starts of its windows that also start earlier in the corpus."""
    if window < WINDOW:  # a shorter one need not hold a phrase with REACH words on both sides
        raise QueryError("window_too_small", f"at least {WINDOW} words")
    keyed, n_ranges = _keyed(docs, column), blocks.ranges(docs.sparkSession, octets(docs, column))
    marks = written(shared_names(keyed, n_ranges).groupBy("id", "tie").agg(F.max("marks").alias("marks")))
    few = _few(marks)
    some = keyed if few is None else keyed.join(few, ["id", "tie"], "left_semi")  # texts that cannot repeat stay where they are
    return written(later_windows(some.join(marks, ["id", "tie"]), n_ranges, window))


def _few(table: DataFrame) -> DataFrame | None:
    """The keys of a table for a broadcast, if they are small enough for one."""
    return F.broadcast(table.select("id", "tie")) if table.count() * 16 <= BROADCAST_BYTES else None


def dedup_text(docs: DataFrame, column: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with n_words, n_removed and kept (its words that stay, joined by one space) added."""
    found = repeats(docs, column, window)
    added = "n_words bigint, n_removed bigint, kept string"
    rows, schema, at, kept_columns = carried(docs, column, added)
    place = len(rows.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at):
            kept, total, gone = [], [], []
            for text, starts in zip(batch.column(at).to_pylist(), batch.column(place).to_pylist(), strict=True):
                words = text.encode().split() if text else []
                total.append(len(words))
                if starts:
                    begin = np.frombuffer(starts, "<u4").astype(np.int64)
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield extended(batch, kept_columns, added, [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())])

    other = found.select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), F.col("starts").alias("_starts"))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)) == F.col("_id")) & (F.xxhash64(rows[at]) == F.col("_tie"))
    few = _few(found)
    if few is None:
        return rows.join(other, same, "left").select(*rows.columns, "_starts").mapInArrow(spared(cut), schema)
    keys = few.withColumnsRenamed({"id": "_id", "tie": "_tie"})
    hit = rows.join(F.broadcast(keys), same, "left_semi").join(other, same).select(*rows.columns, "_starts")
    whole = rows.join(F.broadcast(keys), same, "left_anti").withColumn("_starts", F.lit(None).cast("binary"))
    return hit.unionByName(whole).mapInArrow(spared(cut), schema)
