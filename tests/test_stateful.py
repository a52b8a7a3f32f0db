"""Keyed operators as streams: late and disordered events, restarts, timers; against the batch forms and plain loops."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import keyed
from quern.sources.durable import new_path
from quern.streaming import stateful as S

DDL = "k string, ms long, id long, text string, version long, rejected boolean, cost long"
FAR = [("end", 10**12, 10**6, "", 0, False, 0)]


def log(n=120, seed=2):
    rng = np.random.default_rng(seed)
    times = np.cumsum(rng.integers(0, 40, n))
    return [("abc"[rng.integers(3)], int(t), i, [None, "x", "y", ""][rng.integers(4)], int(rng.integers(0, 30)), bool(rng.random() < 0.1), int(rng.integers(1, 3))) for i, t in enumerate(times)]


def fed(spark, parts, processor, *rule, body=(), late="1 day", between=False):
    """Rows of the stream over ``parts``, a file each; ``between``: stopped and started anew after every part."""
    source, out, checkpoint = (new_path(spark, x) for x in ("in", "out", "log"))
    schema = spark.createDataFrame([], DDL).schema

    def run():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        found = S.keyed_stream(events, "k", "ms", "id", processor, *rule, body=body, late=late)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    for part in parts:
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(source)
        if between:
            run()
    if not between:
        run()
    return Counter(tuple(r) for r in spark.read.parquet(out).collect() if r["k"] != "end")


def by_key(rows):
    for k in sorted({r[0] for r in rows}):
        yield k, sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))


@pytest.mark.parametrize("between", [False, True])
def test_token_bucket_and_sessions_equal_the_batch(spark, between):
    rows = log()
    df = spark.createDataFrame(rows, DDL)
    parts = [rows[1::2], rows[0::2], FAR]  # the second file holds earlier events
    want = Counter(map(tuple, keyed.token_bucket(df, "k", "ms", "id", 3, 1, 70).collect()))
    assert fed(spark, parts, S.TokenBucket, 3, 1, 70, between=between) == want
    want = Counter(map(tuple, keyed.sessions(df, "k", "ms", "id", 60).collect()))
    assert fed(spark, parts, S.Sessions, 60, between=between) == want


def test_outbox_and_debounce_equal_the_batch(spark):
    rows = log(seed=5)
    df = spark.createDataFrame(rows, DDL)
    parts = [rows[60:], rows[:60], FAR]
    want = Counter(map(tuple, keyed.outbox(df, "k", "id", F.col("rejected")).select("k", "id", "status").collect()))
    assert fed(spark, parts, S.Outbox, body=("rejected",)) == want
    want = Counter(map(tuple, keyed.debounce_log(df, "k", "ms", "id", "text", 50).collect()))
    assert fed(spark, parts, S.Debounce, 50, body=("text",), between=True) == want and want


def test_costs_of_events(spark):
    rows, want = log(seed=7), Counter()
    for k, own in by_key(rows):
        have, at = 3, own[0][1]
        for r in own:
            ticks = (r[1] - at) // 70
            have, at = have + ticks, at + ticks * 70
            if have >= 3:
                have, at = 3, r[1]
            have -= r[6] * (ok := have >= r[6])
            want[k, r[2], ok, have] += 1
    assert fed(spark, [rows, FAR], S.TokenBucket, 3, 1, 70, body=("cost",)) == want


def test_presence_of_the_last_writer_with_a_time_to_live(spark):
    rows, want = log(seed=9), Counter()
    for k, own in by_key(rows):
        held = None
        for _, ms, _, text, version, _, _ in [*own, ("", 10**11, 0, None, -1, 0, 0)]:
            if held and ms > held[2] + 100:
                want[k, held[2] + 101, held[0], held[1], False] += 1
                held = None
            if version >= 0 and (held is None or version >= held[1]):
                held = (text, version, ms)
                want[k, ms, text, version, True] += 1
    assert fed(spark, [rows[0::3], rows[1::3], rows[2::3], FAR], S.Presence, 100, body=("text", "version")) == want
    assert any(not r[4] for r in want)


def test_replays_give_the_recorded_result(spark):
    rows, want = log(seed=11), Counter()
    for k, own in by_key(rows):
        first = None
        for r in own:
            if first is None or r[1] >= first[1] + 500:
                first = r
            want[k, r[2], first[2], first[3], r is not first] += 1
    assert fed(spark, [rows, FAR], S.FirstWins, 500, body=("text",), between=True) == want


def test_events_as_they_come(spark):
    """Without a lateness nothing waits: every micro-batch gives its rows at once, the last ones too."""
    rows = log(60, seed=13)
    got = fed(spark, [rows[:30], rows[30:]], S.Outbox, body=("rejected",), late=None)
    assert sum(got.values()) == 60
