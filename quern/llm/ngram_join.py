"""Jaccard self-join on word n-grams: a size-aware heavy-light join, exact whatever the sizes.

Equal sets are one class. A class links with nothing unless 3/4 (the threshold) of its n-grams occur
in other documents, so a first exchange of fingerprints finds the few classes that can link at all.
Those are joined by size:

* light pairs (smaller set at most ``boundary``): two sets of sizes n and m link exactly if they share
  a subset of the overlap that n and m require, so both enumerate their subsets of that fixed size;
  whoever shares one is linked, without verification. The boundary is where the subsets of the next
  size would outnumber the inverted-list entries that they replace.
* heavy pairs: inverted lists over each set's rarest n-grams (the prefix that any linked pair must
  share), scanned with a bound on the overlap still possible. Before that, sets gather around central
  ones that share a min-hash, so lists of near copies name components and not pairs; a pair is
  verified by its full sets, and only if its ends are not connected yet.

Links between different sets thus keep their components whole. Null, empty and word-less texts have
an empty set and link with nothing. Rows that repeat a text fall in one class. A null ``doc_id``
counts as the smallest. An empty table gives an empty result; other columns take no part.
Sets hold 64-bit fingerprints of n-grams; a class is named by 128 bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import blocks
from quern.llm.graph import components
from quern.llm.spark import beside, by_key, octets, written
from quern.llm.texts import chunks, mix, rows_of, spared, window_hashes, word_hashes

#: A link: NUM * intersection * ... >= share of the union, as a fraction.
SHARE = (3, 4)
WORDS = 5
ROUNDS = 3
#: A subset is hashed, sorted and sent; a list entry is only compared.
SUBSET_COST = 8
#: Sizes that can be light at all: of a larger set alone there are over 10**11 subsets.
LIGHT_SIZES = 64
#: A subset's ``place`` is this plus the size of the sets that it is meant for.
SUBSET = 0xFFFFFF00


def overlap(n, m, share: tuple[int, int] = SHARE):
    """Least intersection of linked sets of sizes n and m."""
    p, q = share
    return -(-p * (n + m) // (p + q))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram fingerprints of each text, concatenated, and each text's offset."""
    h, first = word_hashes(texts, lower=True)
    count = np.diff(first)
    w = window_hashes(h, words)
    row = rows_of(first)
    last = first[1:][row[: len(w)]] if len(w) else np.zeros(0, np.int64)
    whole = np.arange(len(w)) + words <= last
    keys, owner = w[whole], row[: len(w)][whole]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):  # the whole sequence is the only n-gram
        one = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = count[short] > k
            one[has] = one[has] * np.uint64(0x9E3779B97F4A7C15) + h[first[:-1][short][has] + k]
        keys, owner = np.concatenate([keys, mix(one + count[short].astype(np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(len(count) + 1))


def class_names(keys: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A 128-bit name of each set."""
    total = np.zeros((len(keys) + 1, 2), np.uint64)
    total[1:, 0], total[1:, 1] = np.cumsum(keys), np.cumsum(mix(keys + np.uint64(0x5851F42D4C957F2D)))
    sums = total[at[1:]] - total[at[:-1]]
    raw = np.stack([mix(sums[:, 0]), mix(sums[:, 1] + np.diff(at).astype(np.uint64))], axis=1).tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(at) - 1)]


def describe(docs: DataFrame, column: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, tie (hash of the text), name of the set's class, n (set size) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column):
            keys, at = shingle_sets(batch.column(2), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(class_names(keys, at), pa.binary()), pa.array(np.diff(at), pa.int64())], ["doc_id", "tie", "name", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(column).alias("tie"), column)
    return rows.mapInArrow(spared(run), "doc_id long, tie long, name binary, n long")


def _sets_of(batches: Iterator[pa.RecordBatch], column: str, words: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    for batch in chunks(batches, column):
        keys, at = shingle_sets(batch.column(batch.schema.get_field_index(column)), words)
        yield class_names(keys, at), keys, at


def can_link(docs: DataFrame, column: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE, text_bytes: int | None = None) -> DataFrame:
    """Names of the classes of which enough n-grams occur in other rows to link at all: name."""
    n_ranges = blocks.ranges(docs.sparkSession, octets(docs, column) if text_bytes is None else text_bytes)
    p, q = share

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, parts, total, number = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            size = np.concatenate(sizes)
            h, owner, _, again = blocks.local(np.concatenate(parts), np.repeat(np.arange(len(size), dtype=np.uint32), size))
            shared = np.bincount(again, minlength=len(size)).astype(np.uint32)
            me = blocks.block_id(number)
            rows = [(r, me, b"e" + blocks.pack((x >> np.uint64(16)), o)) for r, (x, o) in blocks.sliced(h, n_ranges, owner)]
            rows.append((blocks.home(me, n_ranges), me, b"d" + blocks.pack(np.frombuffer(b"".join(names), np.uint8), size.astype(np.uint32), shared)))
            return blocks.blobs(rows)

        for name, keys, at in _sets_of(batches, column, words):
            names += name
            sizes.append(np.diff(at))
            parts.append(keys)
            total += len(keys)
            if total > blocks.BLOCK_HASHES:
                yield out()
                names, sizes, parts, total, number = [], [], [], 0, number + 1
        if names:
            yield out()

    def answer(block: list, payload: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = [(0, b, x) for b, x in zip(block, payload, strict=True) if x[:1] == b"d"]
        entries = [(b, blocks.unpack(x[1:])) for b, x in zip(block, payload, strict=True) if x[:1] == b"e"]
        if entries:
            h = np.concatenate([e[0] for _, e in entries])
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            hit = np.zeros(len(h), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            at = 0
            for b, (x, owner) in entries:
                mine = owner[hit[at : at + len(x)]]
                at += len(x)
                who, count = np.unique(mine[mine != blocks.MANY], return_counts=True)
                if len(who):
                    rows.append((0, b, b"c" + blocks.pack(who, count.astype(np.uint32))))
        yield blocks.blobs(rows)

    def decide(_: list, payload: list[bytes]) -> Iterator[pa.RecordBatch]:
        names, size, shared = next(blocks.unpack(x[1:]) for x in payload if x[:1] == b"d")
        shared = shared.copy()
        for x in payload:
            if x[:1] == b"c":
                who, count = blocks.unpack(x[1:])
                shared[who] += count
        raw = names.tobytes()
        keep = np.flatnonzero((size > 0) & (q * shared.astype(np.int64) >= p * size.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([raw[16 * i : 16 * i + 16] for i in keep.tolist()], pa.binary())], ["name"])

    sent = docs.select(column).mapInArrow(spared(send), blocks.BLOBS)
    return blocks.by_group(blocks.by_group(sent, "range", answer, blocks.BLOBS), "block", decide, "name binary").distinct()


def members(sets: DataFrame, text_bytes: int, share: tuple[int, int] = SHARE, words: int = WORDS) -> DataFrame:
    """From (name, text): name, n, mass (mean log frequency), marks (min-hashes), keys (sorted), prefix (rarest n-grams), their places and summed frequency (scan)."""
    n_ranges = blocks.ranges(sets.sparkSession, text_bytes)
    p, q = share

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, parts, total, number = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            size, keys = np.concatenate(sizes), np.concatenate(parts)
            h, count = np.unique(keys, return_counts=True)
            me = blocks.block_id(number)
            rows = [(r, me, b"e" + blocks.pack(x, c)) for r, (x, c) in blocks.sliced(h, n_ranges, count.astype(np.uint32))]
            rows.append((blocks.home(me, n_ranges), me, b"d" + blocks.pack(np.frombuffer(b"".join(names), np.uint8), size.astype(np.uint32), keys)))
            return blocks.blobs(rows)

        for batch in chunks(batches, "text"):
            keys, at = shingle_sets(batch.column(1), words)
            names += batch.column(0).to_pylist()
            sizes.append(np.diff(at))
            parts.append(keys)
            total += len(keys)
            if total > blocks.BLOCK_HASHES:
                yield out()
                names, sizes, parts, total, number = [], [], [], 0, number + 1
        if names:
            yield out()

    def answer(block: list, payload: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = [(0, b, x) for b, x in zip(block, payload, strict=True) if x[:1] == b"d"]
        entries = [(b, blocks.unpack(x[1:])) for b, x in zip(block, payload, strict=True) if x[:1] == b"e"]
        if entries:
            h, where = np.unique(np.concatenate([e[0] for _, e in entries]), return_inverse=True)
            count = np.bincount(where, weights=np.concatenate([e[1] for _, e in entries])).astype(np.uint32)
            at = 0
            for b, (x, _) in entries:
                rows.append((0, b, b"f" + blocks.pack(x, count[where[at : at + len(x)]])))
                at += len(x)
        yield blocks.blobs(rows)

    def describe_each(_: list, payload: list[bytes]) -> Iterator[pa.RecordBatch]:
        names, size, keys = next(blocks.unpack(x[1:]) for x in payload if x[:1] == b"d")
        found = [blocks.unpack(x[1:]) for x in payload if x[:1] == b"f"]
        h, f = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        order = np.argsort(h)
        freq = f[order][np.searchsorted(h[order], keys)] if len(keys) else f
        raw, out, at = names.tobytes(), [], 0
        for i, n in enumerate(size.tolist()):
            own, df = keys[at : at + n], freq[at : at + n]
            at += n
            length = n - -(-p * n // q) + 1
            rare = np.lexsort((own, df))[:length]
            place = np.flatnonzero(df[rare] > 1)
            marks = [int(mix(own + np.uint64(k)).min().astype(np.int64)) for k in range(1, ROUNDS + 1)]
            out.append((raw[16 * i : 16 * i + 16], n, float(np.log2(df).mean()), marks, own.tobytes(), own[rare[place]].tobytes(), place.astype("<u4").tobytes(), int(df[rare[place]].sum())))
        cols = list(zip(*out, strict=True))
        types = [pa.binary(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        names = ["name", "n", "mass", "marks", "keys", "prefix", "place", "scan"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols or [[]] * 8, types, strict=True)], names)

    sent = sets.select("name", "text").mapInArrow(spared(send), blocks.BLOBS)
    schema = "name binary, n long, mass double, marks array<long>, keys binary, prefix binary, place binary, scan long"
    return blocks.by_group(blocks.by_group(sent, "range", answer, blocks.BLOBS), "block", describe_each, schema)


def linked(pairs: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets link."""
    p, q = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(q * both >= p * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("name").alias("a"), F.col("keys").alias("x")), "a")
    both = left.join(sets.select(F.col("name").alias("b"), F.col("keys").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(spared(run), "a binary, b binary")


def subsets(n: int, boundary: int, share: tuple[int, int] = SHARE) -> list[tuple[int, int, int]]:
    """(other size, overlap, number of subsets) for each size that a set of size n can link lightly with."""
    p, q = share
    sizes = [m for m in range(-(-p * n // q), q * n // p + 1) if min(n, m) <= boundary]
    return [(m, k, comb(n, k)) for m in sizes if (k := overlap(n, m, share)) <= min(n, m) and (m, k) != (n, n)]


def boundary_of(members: DataFrame, share: tuple[int, int] = SHARE) -> int:
    """The boundary at which light and heavy sets cost least together, from the number of sets of each size and their list entries."""
    p, q = share
    rows = members.groupBy(F.least("n", F.lit(LIGHT_SIZES)).alias("n")).agg(F.count(F.lit(1)).alias("c"), F.sum("scan").alias("scan")).collect()
    sizes = {r["n"]: (r["c"], r["scan"]) for r in rows}
    best, least = 0, sum(scan for _, scan in sizes.values())
    for b in range(1, p * LIGHT_SIZES // q):
        light = SUBSET_COST * sum(c * sum(k for *_, k in subsets(n, b, share)) for n, (c, _) in sizes.items() if n * p <= b * q)
        if light >= least:
            break  # subsets only grow in number
        cost = light + sum(scan for n, (_, scan) in sizes.items() if n > b)
        best, least = (b, cost) if cost < least else (best, least)
    return best


def _lists(roots: DataFrame, boundary: int, n_ranges: int, share: tuple[int, int]) -> DataFrame:
    """Pairs that inverted lists and subsets bring together: a, b, sure (shares a subset, so linked).

    Of the pairs that a shared subset proves, a spanning star across the two sizes is given.
    """
    p, q = share

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                names, n, prefix, place, keys, root = (part.column(i).to_pylist() for i in range(6))
                hs, owner, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
                for i, size in enumerate(n):
                    if size > boundary:
                        h, w = np.frombuffer(prefix[i], np.uint64), np.frombuffer(place[i], "<u4")
                        hs.append(h)
                        where.append(w)
                        owner.append(np.full(len(h), i, np.uint32))
                    if size * p <= boundary * q:
                        own = np.frombuffer(keys[i], np.uint64)
                        for m, k, _ in subsets(size, boundary, share):
                            salt = np.uint64(min(size, m) << 32 | max(size, m))
                            salted = mix(own + salt)
                            h = mix(np.array([salted[list(c)].sum() for c in itertools.combinations(range(size), k)], np.uint64))
                            hs.append(h)
                            where.append(np.full(len(h), SUBSET + m, np.uint32))
                            owner.append(np.full(len(h), i, np.uint32))
                hs, owner, where = np.concatenate(hs), np.concatenate(owner), np.concatenate(where)
                order = np.argsort(hs, kind="stable")
                me, rows = blocks.block_id(number), []
                number += 1
                for r, (h, o, w) in blocks.sliced(hs[order], n_ranges, owner[order], where[order]):
                    used, o = np.unique(o, return_inverse=True)
                    table = np.frombuffer(b"".join(names[i] + root[i] for i in used), np.uint8)
                    rows.append((r, me, blocks.pack(h, o.astype(np.uint32), w, table, np.array([n[i] for i in used], np.uint32))))
                yield blocks.blobs(rows)

    def scan(_: list, payload: list[bytes]) -> Iterator[pa.RecordBatch]:
        hs, who, place, sizes, table, base = [], [], [], [], [], 0
        for x in payload:
            h, o, w, t, s = blocks.unpack(x)
            hs.append(h)
            who.append(o.astype(np.int64) + base)
            place.append(w)
            sizes.append(s.astype(np.int64))
            table.append(t.tobytes())
            base += len(s)
        h, who, place, size, raw = np.concatenate(hs), np.concatenate(who), np.concatenate(place), np.concatenate(sizes), b"".join(table)
        name = np.array([raw[32 * i : 32 * i + 16].hex() for i in range(base)])
        _, root = np.unique([raw[32 * i + 16 : 32 * i + 32].hex() for i in range(base)], return_inverse=True)
        order = np.argsort(h, kind="stable")
        h, who, place = h[order], who[order], place[order]
        cut = np.flatnonzero(np.append(h[1:] != h[:-1], True)) + 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        sure: set[tuple[int, int]] = set()
        for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True):
            if b - a < 2 or (root[who[a:b]] == root[who[a]]).all():
                continue
            w, at = who[a:b], place[a:b].astype(np.int64)
            subset = at >= SUBSET
            if subset.any():
                one, other = w[subset], at[subset] - SUBSET  # a hash is of one pair of sizes
                mine = size[one] == size[one[0]]
                left, right = (one, one) if other[0] == size[one[0]] else (one[mine], one[~mine])
                if len(right):
                    star = [(left[0], x) for x in right] + [(x, right[0]) for x in left[1:]]
                    sure.update((int(x), int(y)) for x, y in star if root[x] != root[y])
            w, at = w[~subset], at[~subset]
            n, left, r = size[w], size[w] - at, root[w]
            for i in range(0, len(w), 256):  # a strip of the triangle at a time
                s = slice(i, i + 256)
                ok = np.minimum(left[s, None], left[None, i:]) * (p + q) >= p * (n[s, None] + n[None, i:])
                ok &= r[s, None] != r[None, i:]
                x, y = np.nonzero(np.triu(ok, 1))
                if len(x):
                    found.append((w[i + x], w[i + y]))
        rows = {(a, b, True) if a < b else (b, a, True) for a, b in ((name[x], name[y]) for x, y in sure)}
        if found:
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            rows |= {(a, b, False) if a < b else (b, a, False) for a, b in zip(name[x].tolist(), name[y].tolist(), strict=True) if a != b}
        cols = list(zip(*rows, strict=True)) if rows else ([], [], [])
        hexed = [pa.array([bytes.fromhex(str(v)) for v in c], pa.binary()) for c in cols[:2]]
        yield pa.RecordBatch.from_arrays([*hexed, pa.array(cols[2], pa.bool_())], ["a", "b", "sure"])

    sent = roots.select("name", "n", "prefix", "place", "keys", "root").mapInArrow(spared(send), blocks.BLOBS)
    return blocks.by_group(sent, "range", scan, "a binary, b binary, sure boolean").distinct()


def links(docs: DataFrame, column: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE, rows: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between classes that connect every component; ``rows``: what ``describe`` gives."""
    rows = written(describe(docs, column, words)) if rows is None else rows
    text_bytes = octets(docs, column)
    able = can_link(docs, column, words, share, text_bytes)
    classes = rows.groupBy("name").agg(F.min(F.struct("doc_id", "tie")).alias("one"))  # summed up before it is shuffled
    first = written(classes.join(able, "name", "left_semi").select("name", "one.*"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(column).alias("_tie"), F.col(column).alias("text"))
    texts = keyed.join(beside(first), keyed["_id"].eqNullSafe(first["doc_id"]) & (keyed["_tie"] == first["tie"])).select("name", "text")
    known = members(texts, text_bytes, share, words).dropDuplicates(["name"])
    roots, out = written(known), None
    total = roots.count()
    sets = roots
    left = roots.select("name", "mass", "marks")
    for k in range(ROUNDS):
        led = left.groupBy(F.col("marks")[k].alias("mark")).agg(F.max(F.struct("mass", "name"))["name"].alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
        pairs = by_key(left.select(F.col("name").alias("a"), F.col("marks")[k].alias("mark")), written(led), "mark", "c", total).where("a <> b").select("a", "b")
        got = written(linked(pairs, sets, share))
        left = left.join(got, left["name"] == got["a"], "left_anti")
        out = got if out is None else out.union(got)
    # Three rounds, each to a set that is still a root: three steps lead to the last root.
    up = out.select(F.col("a").alias("x"), F.col("b").alias("y"))
    rooted = sets.join(up.select(F.col("x").alias("name"), F.col("y").alias("r1")), "name", "left")
    for k in range(1, ROUNDS):
        rooted = rooted.join(up.select(F.col("x").alias(f"r{k}"), F.col("y").alias(f"r{k + 1}")), f"r{k}", "left")
    rooted = rooted.withColumn("root", F.coalesce(*(f"r{k}" for k in range(ROUNDS, 0, -1)), "name"))
    found = written(_lists(rooted, boundary_of(sets, share), blocks.ranges(docs.sparkSession, text_bytes), share))
    sure = found.where("sure").select("a", "b")
    return written(out.union(sure).union(linked(found.where("not sure").select("a", "b"), sets, share)))


def join(docs: DataFrame, column: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """Every row of ``docs``: doc_id, tie (hash of the text), n_shingles, component_id (smallest doc_id reachable), component (a name; null for empty sets)."""
    rows = written(describe(docs, column, words))
    found = components(links(docs, column, words, share, rows))
    least = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"]
    classes = written(rows.where("n > 0").groupBy("name").agg(least.alias("least"), F.count(F.lit(1)).alias("copies")))
    named = written(classes.join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name")))
    groups = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNotNull(), "least"))["least"].alias("component_id"), F.count(F.lit(1)).alias("members"))
    of_class = by_key(named, written(groups), "root", "members", named.count())
    of_class = written(of_class.select("name", "component_id", F.col("root").alias("component"), "copies"))
    out = by_key(rows.where("n > 0"), of_class, "name", "copies", rows.count()).select("doc_id", "tie", F.col("n").alias("n_shingles"), "component_id", "component")
    bare = rows.where("n = 0").select("doc_id", "tie", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    return out.union(bare)
