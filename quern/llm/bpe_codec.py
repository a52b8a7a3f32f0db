"""Byte-level BPE encoding and decoding over a minimal acyclic transducer of frequent words.

The corpus is counted once; its most frequent pre-tokens are compiled, with their token ids, into a
minimal acyclic automaton that shares prefixes and suffixes. Transitions carry the number of words
that sort before them, so a walk sums to a word's ordinal, which addresses the id lists. The lexicon
is one flat file, sent to the executors once and memory-mapped there. A pre-token that it lacks is
merged exactly by rank.

``encode`` keeps every input column and adds ``ids`` (binary: little-endian unsigned 32-bit) and
``n_tokens``; ``decode`` adds ``decoded``. Null and empty texts give no ids and decode to "".
Special tokens' strings in a text become their ids, as the tokenizers library does. Rows are
independent: repeated rows give equal results, an empty table gives an empty one, and columns with
clashing names are replaced by the operator's own.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import mmap
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.spark import bounded, dropped, new_path, put_bytes, written
from quern.llm.texts import SPACE, buffers, chunks, column_of, dealt, distinct, listed, spared

#: White space of the pre-tokenizer's pattern; a unit is a run of it with the solid run that follows.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = re.compile(rf"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Fixed value: the byte-level pre-tokenizer's pattern.
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for Latin units after one white space at most, many at a time; what ends a unit there (no text holds it).
PLAIN = re.compile("[ \n]?[!-~\u00a1-\u017f]+")
END = "\ud800"
#: What tells that not all of some units, each with an end, are such.
ODD = re.compile(rf"[^ \n!-~\u00a1-\u017f{END}]|[ \n][ \n{END}]")
_L, _N = (re.escape("".join(c for c in map(chr, range(0x21, 0x180)) if unicodedata.category(c)[0] == kind)) for kind in "LN")
PLAIN_PRETOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^ \n{END}{_L}{_N}]+|\n|{END}")
#: Code points of the white space beyond ASCII.
WIDE = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
LEXICON_WORDS = 50_000
#: Bytes of text that are encoded at once.
TEXT_BYTES = 1 << 20
#: Words that are merged at once: their matrices fit a core's cache.
MERGED_WORDS = 2_000
#: Bytes that a task remembers of units, in two generations; it forgets all when it ends.
MEMO_BYTES = 32 << 20
#: Bytes of a remembered entry beside its text and ids.
ENTRY_BYTES = 190
#: Units of the tables in which a task counts them before it sends what it has.
COUNT_UNITS = 450_000


def pretokens(units: Iterable[str]) -> tuple[list[str], list[str]]:
    """The units in an order of their own, and the pre-tokens of all, each unit's followed by ``END``."""
    plain, rest = list(units), []
    text = END.join([*plain, ""])
    if ODD.search(text):
        units, plain = plain, []
        for u in units:
            (plain if PLAIN.fullmatch(u) else rest).append(u)
        text = END.join([*plain, ""])
    cut = PLAIN_PRETOKENS.findall(text)
    for u in rest:
        cut += PRETOKENS.findall(u)
        cut.append(END)
    return plain + rest, cut


def unit_edges(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where the units of UTF-8 bytes start, and the length at the end; units end at ``borders``, as texts do."""
    white = SPACE[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        a, b, c = (np.append(data, [0, 0])[lead + k].astype(np.int64) for k in range(3))
        two = a == 0xC2
        wide = np.isin(np.where(two, (a & 0x1F) << 6 | b & 0x3F, (a & 0xF) << 12 | (b & 0x3F) << 6 | c & 0x3F), WIDE)
        for k in range(3):
            white[lead[wide & ~two if k == 2 else wide] + k] = True
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = white[1:] & ~white[:-1]
    start[borders] = True
    start[[0, -1]] = True
    return np.flatnonzero(start)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Places:
    """Where each of some distinct keys (64-bit, 0 or more) stands, by a hash table with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.int64), -1)
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), len(keys), np.int32)
        left = np.arange(len(keys))
        slot = self._slot(self.keys[:-1])
        while len(left):
            free = self.slots[slot] == len(keys)
            self.slots[slot[free]] = left[free]  # of those for one slot the last stays
            out = self.slots[slot] != left
            left, slot = left[out], (slot[out] + 1) % len(self.slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or how many there are for one that is none of them."""
        slot = self._slot(keys)
        at = self.slots[slot]
        held = self.keys[at]
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.slots)
            at[left] = self.slots[slot[left]]
            held = self.keys[at[left]]
            left = left[(held != keys[left]) & (held >= 0)]
        return at


def vocabulary(path: str) -> tuple[pa.Array, dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Of a byte-level BPE file: the bytes of every id, special tokens, the ids of single bytes, pairs by rank and their new ids.

    All of it in few objects: a worker keeps them, and what is only needed here goes.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in byte_letters().items()}
    raw = lambda s: bytes(back[c] for c in s)
    ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    merges = [[raw(p) for p in (m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    pair = np.array([ids[x] << 32 | ids[y] for x, y in merges], np.int64)
    new = np.array([ids[x + y] for x, y in merges], np.int64)
    table = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for k, v in [*ids.items(), *((k.encode(), v) for k, v in special.items())]:
        table[v] = k
    return pa.array(table, pa.large_binary()), special, np.array([ids[bytes([b])] for b in range(256)]), pair, new


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        self.parts, self.special, self.single, self.pair, self.new = vocabulary(path)
        self.none = len(self.parts)  # the id of no token

    @functools.cached_property
    def table(self) -> list[bytes]:
        """The bytes of every id, one by one; only for texts that are no UTF-8."""
        return self.parts.to_pylist()

    @functools.cached_property
    def places(self) -> Places:
        """A pair's place is its rank. This and the next two are made where something is merged, not where ids are decoded."""
        return Places(self.pair)

    @functools.cached_property
    def first(self) -> np.ndarray:
        """Ranks of the pairs of bytes."""
        return self.places.of((self.single[:, None] << 32 | self.single[None, :]).ravel()).reshape(256, 256)

    @functools.cached_property
    def ranks(self) -> dict[int, tuple[int, int]]:
        """Rank and new id of every pair, for the longest words only."""
        return dict(zip(self.pair.tolist(), enumerate(self.new.tolist()), strict=True))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed token ids of distinct pre-tokens: the lowest-ranked pair first, leftmost among equals.

        Words of like length merge together, one pair per word and round, as rows of a matrix.
        """
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        low = 0
        for high in (8, 12, 16, 24, 32, 64):
            chosen = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for at in range(0, len(chosen), MERGED_WORDS):
                some = chosen[at : at + MERGED_WORDS].tolist()
                for i, ids in zip(some, self._merge_rows([words[i] for i in some], high), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(lengths > low).tolist():
            out[i] = np.array(self._merge_long(self.single[list(words[i])].tolist()), "<u4").tobytes()
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        n, none = len(words), len(self.new)
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        here = np.arange(width)
        alive = here < size[:, None]
        # Flat places of a matrix with one more column, which stands for the end and, before a first symbol, for the start.
        wide = width + 1
        sym = np.full((n, wide), self.none)
        sym[:, :width] = np.where(alive, self.single[raw], self.none)
        rank = np.full((n, wide), none, np.int32)
        rank[:, : width - 1] = np.where(alive[:, 1:], self.first[raw[:, :-1], raw[:, 1:]], none)
        nxt = np.tile(np.minimum(here + 1, width), (n, 1))
        prv = np.tile(np.append(np.where(here, here - 1, width), 0), (n, 1))
        rows = np.arange(n)
        while len(rows):
            held = rank if len(rows) == n else rank[rows]
            j = held.argmin(axis=1)
            least = held[np.arange(len(rows)), j]
            more = least < none
            rows, j, least = rows[more], j[more], least[more]
            k = nxt[rows, j]
            after = nxt[rows, k]
            new = self.new[least]
            sym[rows, j] = new
            nxt[rows, j] = after
            prv[rows, after] = j
            alive[rows, k] = False
            rank[rows, k] = none
            before = prv[rows, j]
            found = self.places.of(np.concatenate([new << 32 | sym[rows, after], sym[rows, before] << 32 | new]))
            rank[rows, j] = found[: len(rows)]
            rank[rows, before] = found[len(rows) :]
        flat = sym[:, :width][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same by a heap over a linked list, for pre-tokens without any white space."""
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(f[0], i, parts[i], parts[i + 1], f[1]) for i in range(n - 1) if (f := self.ranks.get(parts[i] << 32 | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (f := self.ranks.get(parts[k] << 32 | parts[right[k]])):
                    heapq.heappush(heap, (f[0], k, parts[k], parts[right[k]], f[1]))
        return [p for p in parts if p >= 0]


def compile_lexicon(words: dict[bytes, bytes]) -> bytes:
    """A minimal acyclic transducer from words to packed ids, as one flat file.

    States with equal futures are shared (words arrive sorted, so a state is frozen once no later
    word can pass through it). Layout: five counts; whether each state ends a word; per arc, in order
    of state and byte, its key (state, byte), target and ordinal output; the id lists' offsets; ids.
    """
    frozen: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    below: list[int] = []

    def freeze(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in frozen:
            frozen[key] = len(states)
            states.append(key)
            below.append(int(final) + sum(below[t] for _, t in arcs))
        return frozen[key]

    path: list[list] = [[False, []]]
    last = b""
    ordered = sorted(words)
    for word in ordered:
        same = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), same, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[depth - 1], freeze(final, arcs)))
        for _ in word[same:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        final, arcs = path.pop()
        path[-1][1].append((last[depth - 1], freeze(final, arcs)))
    root = freeze(*path[0])

    final, key, target, output = [], [], [], []
    for state, (ends, arcs) in enumerate(states):
        passed = int(ends)
        final.append(ends)
        for byte, to in arcs:
            key.append(state << 8 | byte)
            target.append(to)
            output.append(passed)
            passed += below[to]
    ids = [words[w] for w in ordered]
    where = np.cumsum([0, *(len(x) // 4 for x in ids)])
    parts = [np.array([len(states), len(key), len(ids), int(where[-1]), root], "<i4")]
    parts += [np.array(x, "<i4") for x in (final, key, target, output, where)]
    return b"".join([*(p.tobytes() for p in parts), *ids])


class Lexicon:
    """A compiled lexicon, read in place from a memory-mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        flat = np.frombuffer(self.map, "<i4")
        n, m, words, total, self.root = flat[:5].tolist()
        at = 5
        for name, size in (("final", n), ("key", m), ("target", m), ("output", m), ("where", words + 1), ("ids", total)):
            setattr(self, name, flat[at : at + size])
            at += size
        self.arcs = Places(self.key)

    def get(self, words: list[bytes]) -> list[bytes | None]:
        """Packed ids of each word, None for those it lacks; all words walk the automaton abreast."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.key) or not words:
            return out
        lengths = np.array([len(w) for w in words])
        starts = np.cumsum(lengths) - lengths
        raw = np.frombuffer(b"".join(words), np.uint8)
        state, ordinal = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        rows, depth = np.flatnonzero(lengths > 0), 0
        ends = []
        while len(rows):
            key = state[rows] << 8 | raw[starts[rows] + depth]
            at = self.arcs.of(key)
            went = at < len(self.key)
            rows, at = rows[went], at[went]
            ordinal[rows] += self.output[at]
            state[rows] = self.target[at]
            depth += 1
            done = lengths[rows] == depth
            ends.append(rows[done][self.final[state[rows[done]]] == 1])
            rows = rows[~done]
        for i in np.concatenate(ends).tolist() if ends else []:
            out[i] = self.ids[self.where[ordinal[i]] : self.where[ordinal[i] + 1]].tobytes()
        return out


class Codec:
    """Encoder and decoder of one worker: memo, then lexicon, then exact merging."""

    def __init__(self, tokenizer: str, lexicon: str | None):
        self.merges = merges_of(tokenizer)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.forget()
        marks = sorted((m.encode() for m in self.merges.special), key=len, reverse=True)
        self.marks = re.compile(b"|".join(map(re.escape, marks))) if marks else None

    def forget(self) -> None:
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.room = MEMO_BYTES // 2

    def _learn(self, units: list[str]) -> None:
        """Put the ids of units into the memo: pre-tokens by the lexicon, unseen ones by exact merging."""
        units, cut = pretokens(units)
        fresh = list(set(cut) - {END})
        raw = [w.encode() for w in fresh]
        found = self.lexicon.get(raw) if self.lexicon else [None] * len(raw)
        unseen = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unseen, self.merges.merge([raw[i] for i in unseen]), strict=True):
            found[i] = ids
        words = dict(zip(fresh, found, strict=True)) | {END: b"\xff\xff\xff\xff"}
        flat = b"".join(map(words.__getitem__, cut))
        ends = (np.flatnonzero(np.frombuffer(flat, "<u4") == 0xFFFFFFFF) * 4).tolist()
        self.memo.update(zip(units, [flat[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends, strict=False)], strict=True))
        self.room -= 5 * sum(map(len, units)) + ENTRY_BYTES * len(units)

    def _marked(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where special tokens start and end; one that would reach into the next text is none, whatever it hides."""
        raw = data.tobytes()
        found = [m.span() for m in self.marks.finditer(raw)] if self.marks else []
        if not found:
            return np.zeros(0, np.int64)
        touched = (np.searchsorted(offsets, np.array(found) - [0, 1], side="right") - 1).tolist()
        rows = sorted({r for a, b in touched for r in range(a, b + 1)})
        return np.array([x + offsets[r] for r in rows for m in self.marks.finditer(raw[offsets[r] : offsets[r + 1]]) for x in m.span()], np.int64)

    def _packed(self, units: list[str], special: set[str]) -> list[bytes]:
        """Packed ids of distinct units; those in ``special`` are special tokens."""
        if self.room < 0:  # units met again are taken over, so frequent ones are not learned anew
            self.older, self.memo, self.room = self.memo, {}, MEMO_BYTES // 2
        memo, older = self.memo, self.older
        found = list(map(memo.get, units))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        fresh = []
        for i in lacking:
            unit = units[i]
            if unit in special:
                found[i] = self.merges.special[unit].to_bytes(4, "little")
            elif (ids := older.get(unit)) is not None:
                found[i] = memo[unit] = ids
                self.room -= 5 * len(unit) + ENTRY_BYTES
            else:
                fresh.append(unit)
        self._learn(fresh)
        for i in lacking:
            if found[i] is None:
                found[i] = memo[units[i]]
        return found

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Token ids of each text as little-endian unsigned 32-bit integers, and how many; distinct units are looked up once."""
        data, offsets = buffers(texts)
        marked = self._marked(data, offsets)
        edges = unit_edges(data, np.concatenate([offsets, marked])) if len(data) else np.zeros(1, np.int64)
        found, codes = distinct(data, edges)
        units = listed(found)
        special = self.merges.special.keys() & set(units) if len(marked) else set()
        packed = pa.array(self._packed(units, special), pa.large_binary())
        ids, at = dealt(packed, codes, np.searchsorted(edges, offsets))
        return column_of(ids, at), np.diff(at) >> 2


_merges: dict[str, Merges] = {}
_codecs: dict[tuple, Codec] = {}


def merges_of(tokenizer: str) -> Merges:
    """A worker loads each vocabulary once."""
    if tokenizer not in _merges:
        _merges[tokenizer] = Merges(tokenizer)
    return _merges[tokenizer]


def codec(tokenizer: str, lexicon: str | None) -> Codec:
    """The worker's codec; ``lexicon`` names a file that Spark has sent to every executor."""
    key = (tokenizer, lexicon)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokenizer, SparkFiles.get(lexicon) if lexicon else None)
    return _codecs[key]


def decoded(ids: bytes, table: list[bytes]) -> str:
    """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def decoded_all(ids: pa.Array, merges: Merges) -> pa.Array:
    """The texts of a column of packed ids."""
    data, offsets = buffers(ids)
    raw, at = dealt(merges.parts, data.view("<u4"), offsets >> 2)
    try:
        raw.tobytes().decode()
        whole = not ((raw[at[:-1][np.diff(at) > 0]] & 0xC0) == 0x80).any()  # no character goes over from one row to the next
    except UnicodeDecodeError:
        whole = False
    return column_of(raw, at, text=True) if whole else pa.array([decoded(i or b"", merges.table) for i in ids.to_pylist()], pa.string())


def summed(parts: Iterable[pa.Array], times: Iterable[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings of all parts, and the sum of their times."""
    found = pa.concat_arrays(list(parts)).dictionary_encode()
    return found.dictionary, np.bincount(found.indices, np.concatenate(list(times)), len(found.dictionary))


def frequent_words(docs: DataFrame, column: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pre-tokens of the whole corpus, counted per task and then summed by word.

    Units are counted first; pre-tokens are cut from distinct units only. A task's table is emitted
    and emptied when it grows large, so memory is bounded whatever the vocabulary. Counts of counts
    tell how often a word must occur to be among the ``most``; only such words reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words, times = [pa.array([], pa.large_string())], [np.zeros(0)]
            for units, n in held:
                for some in itertools.batched(zip(listed(units), n.tolist(), strict=True), 20_000):
                    known = dict(some)
                    some, cut = pretokens(known)
                    ends = np.flatnonzero(np.fromiter(map(END.__eq__, cut), bool, len(cut)))
                    words.append(pa.array([w for w in cut if w != END], pa.large_string()))
                    times.append(np.repeat([float(known[u]) for u in some], np.diff(ends, prepend=-1) - 1))
            word, n = summed(words, times)
            short = pc.less(pc.utf8_length(word), 64)
            return pa.RecordBatch.from_pydict({"word": word.filter(short).cast(pa.string()), "n": pa.array(n.astype(np.int64)).filter(short)})

        held: list[tuple[pa.Array, np.ndarray]] = []
        room = COUNT_UNITS
        for batch in chunks(batches, column):
            data, offsets = buffers(batch.column(0))
            if not len(data):
                continue
            units, codes = distinct(data, unit_edges(data, offsets))
            held.append((units.cast(pa.large_string()), np.bincount(codes)))
            room -= len(units)
            if room < 0:
                held = [summed(*zip(*held, strict=True))]
                room = COUNT_UNITS - len(held[0][0])
                if room < COUNT_UNITS // 3:
                    yield out()
                    held, room = [], COUNT_UNITS
        held = [summed(*zip(*held, strict=True))] if held else []
        yield out()

    bounded(docs.sparkSession)
    counted = docs.select(column).mapInArrow(spared(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = written(counted)
    # Counts that share their bit length and first three bits share a step: a few hundred rows, whatever the corpus.
    shift = F.greatest(F.length(F.bin("n")) - 4, F.lit(0))
    step = F.expr("1L") * F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), shift), shift)
    steps = counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    least, total, border = 2, 0, None
    for r in steps:
        if total + r["words"] > most:
            border = r
            break
        least, total = r["step"], total + r["words"]
    chosen = (F.col("n") >= least) if total else F.lit(False)
    if border:  # of the step at the border as many as fit, give or take chance, by hash
        chosen |= (step == border["step"]) & (F.pmod(F.xxhash64("word"), F.lit(border["words"])) < most - total)
    found = [r["word"] for r in counted.where(chosen).select("word").collect()]
    dropped(counted)
    return sorted(found)


def send_lexicon(docs: DataFrame, tokenizer: str, column: str = "text", most: int = LEXICON_WORDS) -> str:
    """Compile the corpus's lexicon (at most ``most`` words) and send it to the executors; its file name."""
    spark = docs.sparkSession
    merges = Merges(tokenizer)
    words = [w.encode() for w in frequent_words(docs, column, most)]
    flat = compile_lexicon(dict(zip(words, merges.merge(words), strict=True)))
    path = new_path(spark, "lexicon")  # a name of its own: Spark refuses one name from two places
    put_bytes(spark, path, flat)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _added(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_pydict(kept | columns)


def encode(docs: DataFrame, tokenizer: str, column: str = "text", lexicon: str | None = None, back: bool = False) -> DataFrame:
    """Add ``ids`` (binary) and ``n_tokens`` to every row. ``lexicon``: from ``send_lexicon``, else built here.

    ``back``: add ``decoded`` as ``decode`` does, in the same Python worker; a second one takes room beside it.
    """
    lexicon = lexicon or send_lexicon(docs, tokenizer, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(tokenizer, lexicon)
        try:
            for batch in chunks(batches, column, TEXT_BYTES):
                ids, n = work.encode(batch.column(batch.schema.get_field_index(column)))
                yield _added(batch, {"ids": ids, "n_tokens": pa.array(n, pa.int64())} | ({"decoded": decoded_all(ids, work.merges)} if back else {}))
        finally:  # the worker lives on
            work.forget()

    bounded(docs.sparkSession)
    added = ["ids binary", "n_tokens bigint", *["decoded string"] * back]
    base = docs.drop(*(a.split()[0] for a in added))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *added])
    return base.mapInArrow(spared(run), schema)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Add ``decoded``: the text of ``ids``, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(tokenizer)
        for batch in chunks(batches, "ids"):
            yield _added(batch, {"decoded": decoded_all(batch.column(batch.schema.get_field_index("ids")), merges)})

    base = encoded.drop("decoded")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "decoded string"])
    return base.mapInArrow(spared(run), schema)
