"""The token bucket of hot keys that spread over many ranges, against a plain loop."""

import numpy as np
import pytest

from quern.operators import keyed


def plain(rows, capacity, refill, interval):
    out, buckets = {}, {}
    for k, t, o in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        have, at = buckets.get(k, (capacity, t))
        ticks = (t - at) // interval
        have, at = min(capacity, have + ticks * refill), at + ticks * interval
        at = t if have == capacity else at
        out[o] = (k, have >= 1, max(have - 1, 0))
        buckets[k] = max(have - 1, 0), at
    return out


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("capacity", "refill", "interval", "gap"), [(3, 1, 97, 60), (5, 2, 50, 20), (4, 1, 30, 30), (1, 1, 10, 3)])
def test_hot_key(spark, monkeypatch, capacity, refill, interval, gap):
    monkeypatch.setattr(keyed, "PIECE", 40)
    rng = np.random.default_rng(capacity)
    times = np.cumsum(rng.integers(0, gap, 3000))
    rows = [(None if i % 50 == 7 else 5 if i % 3 else int(i % 11), int(t), i) for i, t in enumerate(times)]
    got = keyed.token_bucket(spark.createDataFrame(rows, "u long, ms long, id long"), "u", "ms", "id", capacity, refill, interval)
    assert got.columns == ["u", "id", "allowed", "tokens"]
    found = {r["id"]: (r["u"], r["allowed"], r["tokens"]) for r in got.collect()}
    assert len(found) == len(rows) and found == plain(rows, capacity, refill, interval)


def test_one_key_of_many_events(spark):
    """A bucket that is never idle: the fold that copied its array at every event did not end."""
    rows = spark.range(200_000).selectExpr("1L as u", "id * 7 as ms", "id")
    got = keyed.token_bucket(rows, "u", "ms", "id", 3, 1, 10)
    assert got.count() == 200_000 and 140_000 <= got.where("allowed").count() <= 140_003


def test_no_rows_and_no_time(spark):
    rows = spark.createDataFrame([(1, None, 9)], "u long, ms long, id long")
    assert [tuple(r) for r in keyed.token_bucket(rows, "u", "ms", "id", 3, 1, 10).collect()] == [(1, 9, None, None)]
