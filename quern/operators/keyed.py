"""Keyed operators over event logs, in batch form."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.sources.durable import beside, written

SESSION_GAP_MS = 300_000
#: Most events of a token bucket's piece.
PIECE = 512


def first_by(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of every key: replays of an operation or an event id are dropped."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def sessions(df: DataFrame, key: str, stamp: str, order: str, gap: int = SESSION_GAP_MS, actor: str | None = None, mark: str | None = None) -> DataFrame:
    """Runs of a key's consecutive events: key, (actor,) session, started, ended, events.

    A run ends where the gap is ``gap`` or more, where the ``actor`` changes (an event between two of another's parts
    them), and behind an event whose ``mark`` is true (a checkpoint stands there).
    """
    w = Window.partitionBy(key).orderBy(stamp, order)
    opens = F.col(stamp) - F.lag(stamp).over(w) >= gap
    if actor:
        opens |= ~F.col(actor).eqNullSafe(F.lag(actor).over(w))
    if mark:
        opens |= F.coalesce(F.lag(mark).over(w), F.lit(False))
    numbered = df.withColumn("_open", F.coalesce(opens.cast("int"), F.lit(1)))
    numbered = numbered.withColumn("session", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, *([actor] if actor else []), "session").agg(F.min(stamp).alias("started"), F.max(stamp).alias("ended"), F.count(F.lit(1)).alias("events"))


def latest(df: DataFrame, key: str, state: str, version: list[str]) -> DataFrame:
    """Last writer wins: the state of the greatest version (an equal version overwrites, by arrival)."""
    return df.groupBy(key).agg(F.max_by(state, F.struct(*version)).alias(state), F.max(F.struct(*version)).alias("version")).select(key, state, *(F.col(f"version.{v}").alias(v) for v in version))


def roster(df: DataFrame, user: str, status_rank: Column, here: Column, image: Column | None = None, order: str | None = None, sessions_of: DataFrame | None = None) -> DataFrame:
    """One row a user over all their tabs: tabs, here, status, (the first image); users of ``sessions_of`` without a presence follow with none."""
    picked = [F.min_by(image, F.when(image.isNotNull(), F.col(order))).alias("image")] if image is not None else []
    out = df.groupBy(user).agg(F.count(F.lit(1)).alias("tabs"), F.bool_or(here).alias("here"), F.max(status_rank).alias("status"), *picked)
    if sessions_of is None:
        return out
    absent = sessions_of.select(user).distinct().join(out.select(user), user, "left_anti")
    return out.unionByName(absent.withColumns({"tabs": F.lit(0).cast("long"), "here": F.lit(False)}), allowMissingColumns=True)


def _spend(state: tuple[int, int], t: list[int], capacity: int, refill: int, interval: int, cost: int = 1) -> tuple[tuple[int, int], list[int]]:
    """A bucket (tokens, start of the open interval) after events at ``t``, and what each found in it."""
    (have, at), found = state, []
    for now in t:
        ticks = (now - at) // interval
        have += ticks * refill
        at += ticks * interval
        if have >= capacity:
            have, at = capacity, now
        found.append(have)
        have -= cost * (have >= cost)
    return (have, at), found


def _map_of(t: np.ndarray, capacity: int, refill: int, interval: int, cost: int = 1) -> list[np.ndarray]:
    """What a piece of events does to any bucket, as sorted rows (tokens, low, at, left, fixed).

    Way in, seen at the first event: so many tokens, and an open interval that began ``low`` or more (up to the next
    row's) ago; a full bucket is the last row. Way out: ``left`` tokens, and an interval that began at ``at``, or,
    unless ``fixed``, at ``at`` less the lag on the way in.
    """
    lows = np.unique(np.append(0, (t[0] - t) % interval))
    tokens, low = np.append(np.repeat(np.arange(capacity), len(lows)), capacity), np.append(np.tile(lows, capacity), 0)
    at, have, fixed, of = t[0] - low, tokens, tokens >= capacity, np.arange(len(low))
    for k, now in enumerate(t.tolist()):
        ticks = (now - at) // interval
        have = have + ticks * refill
        full = have >= capacity
        at, have, fixed = np.where(full, now, at + ticks * interval), np.minimum(have, capacity), fixed | full
        have = have - cost * (have >= cost)
        if k % 32 == 31 and len(at) > 1:  # states that have become equal are followed once
            order = np.lexsort((fixed, have, at))
            new = np.append(True, (np.diff(at[order]) != 0) | (np.diff(have[order]) != 0) | (fixed[order][1:] != fixed[order][:-1]))
            to = np.empty(len(at), np.int64)
            to[order] = np.cumsum(new) - 1
            first = order[new]
            at, have, fixed, of = at[first], have[first], fixed[first], to[of]
    at, have, fixed = at[of], have[of], fixed[of]
    at = np.where(fixed, at, at + low)
    keep = np.append(True, (np.diff(tokens) != 0) | (np.diff(at) != 0) | (np.diff(have) != 0) | (fixed[1:] != fixed[:-1]))
    return [x[keep].astype(np.int64) for x in (tokens, low, at, have, fixed)]


def token_bucket(df: DataFrame, key: str, stamp: str, order: str, capacity: int, refill: int, interval: int, cost: int = 1) -> DataFrame:
    """Every event with ``allowed`` and ``tokens`` left: whole tokens refill each interval, the remainder of time is kept.

    An event spends ``cost`` tokens, or none if there are fewer.

    A bucket that is full again is forgotten, so the next event starts a fresh one.

    Events are dealt by ranges of (key, time, order), so a hot key goes to many tasks, and cut into pieces of one key
    and bounded size. Only the first key of a range may have begun before: its pieces, until the bucket is known
    whatever it was, are described by maps. These are chained by key, then every piece is filled in on its own.
    """
    rule = (capacity, refill, interval, cost)
    size = max(32, min(PIECE, (1 << 16) // max(capacity, 1)))
    names = ("_tokens", "_low", "_at", "_left", "_fixed")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        of, t, o = None, [], []
        for batch in batches:
            for k, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t and (k != of or len(t) == size):
                    yield of, t, o
                    t, o = [], []
                of = k
                t.append(x)
                o.append(y)
        if t:
            yield of, t, o

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, state, of, rows, events = TaskContext.get().partitionId(), None, None, [], 0
        for seq, (k, t, o) in enumerate(pieces(batches)):
            if seq and k != of:
                state = (capacity, t[0])
            of, maps, known = k, [None] * 5, state
            if state is None:
                maps = _map_of(np.array(t, np.int64), *rule)
                if maps[4].all() and len(set(zip(maps[2].tolist(), maps[3].tolist(), strict=True))) == 1:
                    state = (int(maps[3][0]), int(maps[2][0]))
            else:
                state = _spend(state, t, *rule)[0]
            rows.append((me, seq, k, t, o, *(known or (None, None)), *(state or (None, None)), *maps))
            events += len(t)
            if events >= 1 << 16:  # the last row stays: a later batch knows whether it ends the range
                yield packed(rows[:-1], False)
                rows, events = rows[-1:], len(t)
        if rows:
            yield packed(rows, True)

    def packed(rows: list[tuple], ends: bool) -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True), [ends and i == len(rows) - 1 for i in range(len(rows))]] if rows else [[]] * 15
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], fields)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = object(), None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                first, of = r["_k"] != of, r["_k"]
                if r["_tokens"] is None:
                    state = (r["_have_out"], r["_at_out"])
                    continue
                state = (capacity, r["_first"]) if first else state
                out.append((r["_range"], r["_seq"], *state))
                ticks = (r["_first"] - state[1]) // interval
                have, lag = state[0] + ticks * refill, r["_first"] - state[1] - ticks * interval
                have, lag = (capacity, 0) if have >= capacity else (have, lag)
                at = bisect_right(list(zip(r["_tokens"], r["_low"], strict=True)), (have, lag)) - 1
                state = (r["_left"][at], r["_at"][at] - (0 if r["_fixed"][at] else lag))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["_r", "_s", "_have", "_since"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, t, o, have, since = batch.columns
            found = [_spend(s, x, *rule)[1] for s, x in zip(zip(have.to_pylist(), since.to_pylist(), strict=True), t.to_pylist(), strict=True)]
            each = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            flat = np.array([h for f in found for h in f], np.int64)
            yield pa.RecordBatch.from_arrays([k.take(each), o.flatten(), pa.array(flat >= cost), pa.array(flat - cost * (flat >= cost))], ["_k", "_o", "allowed", "tokens"])

    timed = df.where(F.col(stamp).isNotNull()).select(F.col(key).alias("_k"), F.col(stamp).cast("long").alias("_t"), F.col(order).cast("long").alias("_o"))
    kind = timed.schema["_k"].dataType.simpleString()
    many = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), to_arrow_type(timed.schema["_k"].dataType), many, many, *[pa.int64()] * 4, *[many] * 5, pa.bool_()]
    fields = ["_range", "_seq", "_k", "_ts", "_os", "_have_in", "_at_in", "_have_out", "_at_out", *names, "_ends"]
    schema = f"_range long, _seq long, _k {kind}, _ts array<long>, _os array<long>, _have_in long, _at_in long, _have_out long, _at_out long, " + ", ".join(f"{n} array<long>" for n in names) + ", _ends boolean"
    dealt = timed.repartitionByRange("_k", "_t", "_o").sortWithinPartitions("_k", "_t", "_o")
    cuts = written(dealt.mapInArrow(cut, schema))  # once: both passes must see the same ranges
    maps = cuts.where("_have_in is null or _ends").select("_range", "_seq", "_k", F.col("_ts")[0].alias("_first"), F.col("_os")[0].alias("_o"), "_have_out", "_at_out", F.when(F.col("_have_in").isNull(), F.col("_tokens")).alias("_tokens"), *names[1:])
    chained = written(maps.repartition("_k").sortWithinPartitions("_k", "_first", "_o", "_range", "_seq").mapInArrow(chain, "_r long, _s long, _have long, _since long"))
    joined = cuts.join(beside(chained), (F.col("_range") == F.col("_r")) & (F.col("_seq") == F.col("_s")), "left")
    joined = joined.select("_k", "_ts", "_os", F.coalesce("_have_in", "_have"), F.coalesce("_at_in", "_since"))
    out = joined.mapInArrow(fill, f"_k {kind}, _o long, allowed boolean, tokens long")
    bare = df.where(F.col(stamp).isNull()).select(key, F.col(order).cast("long"), F.lit(None).cast("boolean"), F.lit(None).cast("long"))
    return out.union(bare).toDF(key, order, "allowed", "tokens")


def outbox(df: DataFrame, key: str, seq: str, rejected: Column, again: Column | None = None, queue: str | None = None) -> DataFrame:
    """Queued writes with ``status``: a rejected one fails, and so do later ones of the same key.

    One to be tried ``again`` (it and all behind it in its ``queue``) waits.
    """
    before = lambda by: Window.partitionBy(by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max(rejected.cast("int")).over(before(key)), F.lit(0)) == 1
    status = F.when(earlier, "dependency_failed").when(rejected, "rejected")
    if again is not None:
        blocked = F.coalesce(F.max(again.cast("int")).over(before(queue or key)), F.lit(0)) == 1
        status = F.when(blocked | again, "waiting").otherwise(status.otherwise("sent"))
        return df.withColumn("status", status)
    return df.withColumn("status", status.otherwise("sent"))


def jittered(wait: Column, key: Column) -> Column:
    """A wait times a factor in [0.5, 1) that a hash of the key fixes, so reruns agree."""
    return wait * (F.lit(0.5) + F.pmod(F.xxhash64(key), F.lit(1 << 20)) / F.lit(2.0 * (1 << 20)))


def debounced(df: DataFrame, key: str, stamp: str, wait: int, now: int) -> DataFrame:
    """Keys that have been quiet for ``wait`` at ``now``, with the time they fell due."""
    return df.groupBy(key).agg((F.max(stamp) + wait).alias("due_at")).where(F.col("due_at") <= now)


def debounce_log(df: DataFrame, key: str, stamp: str, order: str, text: str, wait: int) -> DataFrame:
    """key, due, text: every time that a key's text had been left as it was for ``wait`` after a change.

    An event that does not change the text does not start the wait anew; a first text that is empty waits for nothing.
    """
    w = Window.partitionBy(key).orderBy(stamp, order)
    now = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(key, stamp, order, now.alias("text")).withColumn("_was", F.coalesce(F.lag("text").over(w), F.lit("")))
    rows = rows.where("text <> _was").withColumn("_next", F.lead(stamp).over(w))
    return rows.where(F.col("_next").isNull() | (F.col("_next") >= F.col(stamp) + wait)).select(key, (F.col(stamp) + wait).alias("due"), "text")


def live(df: DataFrame, stamp: str, now: int, ttl: int) -> DataFrame:
    """Presences that were heard of within ``ttl`` of ``now``."""
    return df.where(F.lit(now) - F.col(stamp) <= ttl)


def without_owner(df: DataFrame, owner: str, gone: DataFrame) -> DataFrame:
    """Presences but for those of connections that ended."""
    return df.join(gone.select(owner).distinct(), owner, "left_anti")


def counted_bucket(df: DataFrame, key: str, stamp: str, order: str, capacity: int, interval: int) -> DataFrame:
    """Every event with the tokens left and whether it passes; a token a refill, and one spent even when there is none.

    Refills never stop at the capacity while spending keeps up, so the level is a running extreme: with the ticks since a
    key's first event as clock, what is spent beyond the refills, less the most that a full bucket cut off so far.
    """
    w = Window.partitionBy(key).orderBy(stamp, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ticks = F.floor((F.col(stamp) - F.min(stamp).over(Window.partitionBy(key))) / interval)
    spent = F.row_number().over(w) - 1
    rows = df.withColumns({"_ticks": ticks, "_spent": spent}).withColumn("_over", F.greatest(F.max(F.col("_ticks") - F.col("_spent")).over(upto), F.lit(0)))
    left = (F.lit(capacity) + F.col("_ticks") - F.col("_over") - F.col("_spent") - 1).cast("long")
    return rows.withColumn("left", left).withColumn("allowed", F.col("left") >= 0).drop("_ticks", "_spent", "_over")


def stale(sources: DataFrame, stored: DataFrame, key: str, text: str, digest: Column) -> DataFrame:
    """Keys whose text has another digest than the stored one (column ``digest``), or none yet."""
    known = stored.select(key, F.col("digest").alias("_digest"))
    return sources.withColumn("_now", digest).join(known, key, "left").where(F.col(text).isNotNull() & ~F.col("_now").eqNullSafe(F.col("_digest"))).select(key)


def retries(df: DataFrame, attempt: str, first: float, most: float, drop_at: int = 8, solo_at: int = 3) -> DataFrame:
    """Failed jobs with what comes next: ``retry`` after ``wait`` seconds, ``solo`` (alone, from ``solo_at`` attempts), or ``drop``."""
    wait = F.least(F.lit(first) * F.pow(F.lit(2.0), F.col(attempt) - 1), F.lit(most))
    step = F.when(F.col(attempt) >= drop_at, "drop").when(F.col(attempt) >= solo_at, "solo").otherwise("retry")
    return df.withColumns({"next": step, "wait": F.when(F.col(attempt) < drop_at, wait)})
