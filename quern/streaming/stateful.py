"""Keyed operators with state and timers over streams: the streaming forms of ``quern.operators.keyed``.

Each is a processor of ``transformWithStateInPandas``: a key's state lives in the state store, survives restarts with the
checkpoint, and is dropped by an event-time timer once it can no longer matter. ``keyed_stream`` feeds one. With ``late``
given, events wait in the state until the watermark has passed them and are then handled in the order of (stamp, order),
whatever the order in which they came; what comes later than the watermark is dropped by Spark. Without it, events are
handled as they come, those of one micro-batch in order. So a stream gives the rows of the batch operator, up to the
watermark. Keys, stamps and orders are not null (rows with a null stamp or key are left out).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quern.operators.keyed import SESSION_GAP_MS, _spend

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Names of the columns that a processor is fed (none begins with a line: pandas would rename it).
STAMP, ORDER = "stamp_ms", "event_order"


class Keyed(StatefulProcessor):
    """Events of a key in order: ``step`` takes the state and an event, ``alarm`` a time that the state waited for.

    ``state``: DDL of the state; ``body``: of what an event carries; ``out``: of the rows; ``start``: its value for a key without one. ``step`` and ``alarm`` give (state, rows);
    a state of None is dropped. ``due`` tells at which time ``alarm`` must be called, or None.
    """

    state = "x long"
    out = "x long"

    def __init__(self, buffered: bool):
        self.buffered = buffered

    def start(self, stamp: int):
        raise NotImplementedError

    def step(self, state, stamp: int, order: int, body: tuple) -> tuple:
        raise NotImplementedError

    def due(self, state) -> int | None:
        return None

    def alarm(self, state, at: int) -> tuple:
        return None, []

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("state", self.state)
        self.waiting = handle.getListState("waiting", f"{STAMP} long, {ORDER} long, {self.body}") if self.buffered else None

    def _run(self, state, events: list[tuple]) -> tuple:
        rows = []
        for stamp, order, *body in events:
            while state is not None and (at := self.due(state)) is not None and at <= stamp:
                state, more = self.alarm(state, at)
                rows += more
            state, more = self.step(self.start(stamp) if state is None else state, stamp, order, body)
            rows += more
        return state, rows

    def _settle(self, key, state, was: bool, now: int, rows: list[tuple], waiting: list[tuple]) -> Iterator[pd.DataFrame]:
        """Fire alarms up to ``now``, store the state, set the one timer that comes next, and give the rows."""
        while state is not None and (at := self.due(state)) is not None and at <= now:
            state, more = self.alarm(state, at)
            rows += more
        if state is not None:
            self.held.update(tuple(state))
        elif was:
            self.held.clear()
        wanted = {t for t in (self.due(state) if state is not None else None, min((e[0] for e in waiting), default=None)) if t is not None}
        wanted = {max(min(wanted), now + 1)} if wanted else set()  # a timer in the past would not fire
        known = set(self.handle.listTimers())
        for t in known - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - known:
            self.handle.registerTimer(t)
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=[c.rsplit(" ", 1)[0] for c in f"_key x, {self.out}".split(", ")])

    def _state(self):
        return self.held.get() if self.held.exists() else None

    def _turn(self, key, new: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        state = self._state()
        was = state is not None
        waiting = []
        if self.buffered:
            held = [tuple(e) for e in self.waiting.get()]
            all_ = held + new
            new = [e for e in all_ if e[0] <= now]
            waiting = [e for e in all_ if e[0] > now]
            if waiting:
                self.waiting.put(waiting)
            elif held:
                self.waiting.clear()
        state, rows = self._run(state, sorted(new, key=lambda e: e[:2]))
        yield from self._settle(key, state, was, now, rows, waiting)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [STAMP, ORDER, *(f.split()[0] for f in self.body.split(", "))]
        new = [tuple(None if v is None or v != v else v for v in r) for part in rows for r in part[names].astype(object).itertuples(index=False, name=None)]
        new = [(int(s), int(o), *body) for s, o, *body in new]
        yield from self._turn(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._turn(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class TokenBucket(Keyed):
    """``token_bucket``: order, allowed, tokens of every event; a bucket that is full again is dropped."""

    state, body, out = "have long, at long", "cost long", "event long, allowed boolean, tokens long"

    def __init__(self, buffered: bool, capacity: int, refill: int, interval: int):
        super().__init__(buffered)
        self.rule = (capacity, refill, interval)

    def start(self, stamp):
        return self.rule[0], stamp

    def step(self, state, stamp, order, body):
        cost = 1 if body[0] is None else int(body[0])
        state, (found,) = _spend(tuple(state), [stamp], *self.rule, cost)
        allowed = found >= cost
        return state, [(order, allowed, found - cost * allowed)]

    def due(self, state):
        have, at = state
        return at + -(-(self.rule[0] - have) // self.rule[1]) * self.rule[2]


class Debounce(Keyed):
    """``debounced``, with the source text: due, text of every quiet spell after a change of the text.

    An event that leaves the text as it is does not start the wait anew; a first text that is empty waits for nothing.
    """

    state, body, out = "text string, due long", "text string", "due long, text string"

    def __init__(self, buffered: bool, wait: int):
        super().__init__(buffered)
        self.wait = wait

    def start(self, stamp):
        return "", None

    def step(self, state, stamp, order, body):
        text = body[0] or ""
        return ((text, stamp + self.wait) if text != state[0] else tuple(state)), []

    def due(self, state):
        return state[1]

    def alarm(self, state, at):
        return (state[0], None), [(at, state[0])]


class Outbox(Keyed):
    """``outbox``: order, status of every queued write; a rejected one fails the later ones of its key."""

    state, body, out = "failed boolean", "rejected boolean", "event long, status string"

    def start(self, stamp):
        return (False,)

    def step(self, state, stamp, order, body):
        failed, rejected = bool(state[0]), bool(body[0])
        return (failed or rejected,), [(order, "dependency_failed" if failed else "rejected" if rejected else "sent")]


class Presence(Keyed):
    """Last writer wins, with a time to live: stamp, state, version, here of every change, and of every presence that was not heard of.

    An older version than the one held is ignored; an equal one overwrites.
    """

    state, body, out = "state string, version long, heard long", "state string, version long", "stamp long, state string, version long, here boolean"

    def __init__(self, buffered: bool, ttl: int):
        super().__init__(buffered)
        self.ttl = ttl

    def start(self, stamp):
        return None, -(1 << 62), stamp

    def step(self, state, stamp, order, body):
        value, version = body[0], int(body[1])
        return (tuple(state), []) if version < state[1] else ((value, version, stamp), [(stamp, value, version, True)])

    def due(self, state):
        return state[2] + self.ttl + 1  # as long as it was heard of within ttl it stays

    def alarm(self, state, at):
        return None, [(at, state[0], state[1], False)]


class FirstWins(Keyed):
    """Replays of an operation within ``keep`` of its first event: order, first (the order of the recorded one), result, replayed."""

    state, body, out = "first long, result string, at long", "result string", "event long, first long, result string, replayed boolean"

    def __init__(self, buffered: bool, keep: int):
        super().__init__(buffered)
        self.keep = keep

    def start(self, stamp):
        return -1, None, stamp

    def step(self, state, stamp, order, body):
        first, result, at = state
        return (tuple(state), [(order, first, result, True)]) if first >= 0 else ((order, body[0], stamp), [(order, order, body[0], False)])

    def due(self, state):
        return state[2] + self.keep if state[0] >= 0 else None


class Sessions(Keyed):
    """``sessions``: session, started, ended, events of every run of events with gaps below ``gap``, once it is over."""

    state, body, out = "session long, started long, ended long, events long", "none string", "session long, started long, ended long, events long"

    def __init__(self, buffered: bool, gap: int = SESSION_GAP_MS):
        super().__init__(buffered)
        self.gap = gap

    def start(self, stamp):
        return 0, 0, 0, 0

    def step(self, state, stamp, order, body):
        session, started, ended, events = state
        return ((session, started, max(ended, stamp), events + 1) if events else (session + 1, stamp, stamp, 1)), []

    def due(self, state):
        return state[2] + self.gap if state[3] else None

    def alarm(self, state, at):
        return (state[0], 0, 0, 0), [tuple(state)]


def keyed_stream(events: DataFrame, key: str, stamp: str, order: str, processor: type[Keyed], *rule, body: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """key and the processor's columns. ``stamp``: milliseconds; ``body``: the columns that the processor takes.

    The session must use the RocksDB state store (``PROVIDER``).
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = events.schema[key].dataType.simpleString()
    fields = [f.split() for f in processor.body.split(", ")]
    given = [*map(F.col, body), *[F.lit(None)] * (len(fields) - len(body))]
    rows = events.where(F.col(stamp).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(key), F.col(stamp).cast("long").alias(STAMP), F.col(order).cast("long").alias(ORDER), *(c.cast(t).alias(n) for (n, t), c in zip(fields, given, strict=True)), F.timestamp_millis(F.col(stamp).cast("long")).alias("event_time"))
    dealt = rows.withWatermark("event_time", late or "0 seconds").groupBy(key)
    found = dealt.transformWithStateInPandas(processor(late is not None, *rule), f"_key {kind}, {processor.out}", "Append", "EventTime")
    return found.withColumnRenamed("_key", key)
