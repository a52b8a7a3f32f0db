"""Live results: folded deltas equal the query run anew, after every change."""

import numpy as np
import pytest

from quern.errors import QueryError
from quern.operators import order as O
from quern.operators.where import where
from quern.sources.durable import new_path
from quern.sources.versions import VersionedTable
from quern.streaming.live import LiveQuery, folded, follow

DDL = "id long, kind string, price double"


def some(rng, keys):
    return [(int(i), "ab"[rng.integers(2)], None if rng.random() < 0.2 else float(rng.integers(0, 12))) for i in keys]


def plain(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(("order", "limit"), [([("kind", "asc"), ("price", "desc")], 5), ([("price", "desc")], None)])
def test_deltas_fold_to_the_result(spark, order, limit):
    rng = np.random.default_rng(len(order) + (limit or 0))
    t = VersionedTable.create(spark, new_path(spark, "versions"), spark.createDataFrame(some(rng, range(30)), DDL), "id", buckets=5)
    condition = {"or": [{"kind": "a"}, {"price": {"gte": 9}}]}
    live = LiveQuery(t, path := new_path(spark, "live"), condition, order, limit, ["id", "price"])

    def anew():
        rows = where(t.read(), condition)
        rows = rows.orderBy(*O.keys(rows, order, "id")).limit(limit) if limit else rows
        return plain(rows.select(*live.fields))

    result = live.advance().drop("delta")
    assert plain(result) == anew()
    next_key = 100
    for step in range(3):
        x = t.begin()
        keys = rng.choice(30, 4, replace=False)
        if step == 1:  # most of the page goes
            x.delete(live.result().select("id"))
        else:
            x.update(spark.createDataFrame(some(rng, keys), DDL)).create(spark.createDataFrame(some(rng, [next_key, next_key + 1]), DDL))
            next_key += 2
        x.commit()
        delta = live.advance()
        assert {r["delta"] for r in delta.collect()} <= {"enter", "leave", "change"}
        result = folded(result, delta, "id")
        assert plain(result) == anew()
        assert plain(live.result()) == anew() and live.version == t.version
        live = LiveQuery(t, path, condition, order, limit, ["id", "price"])  # a restart goes on from the stored page
    assert live.advance().isEmpty()


def test_refills_only_when_rows_move_up(spark):
    t = VersionedTable.create(spark, new_path(spark, "versions"), spark.createDataFrame([(i, "a", float(i)) for i in range(20)], DDL), "id", buckets=4)
    live = LiveQuery(t, new_path(spark, "live"), {"kind": "a"}, [("price", "desc")], 5)
    live.advance()
    t.begin().update(spark.createDataFrame([(3, "a", 50.0)], DDL)).commit()
    assert {(r["delta"], r["id"]) for r in live.advance().collect()} == {("enter", 3), ("leave", 15)} and live.refills == 0
    t.begin().delete(spark.createDataFrame([(19,)], "id long")).commit()
    live.advance()
    assert live.refills == 1 and [r["id"] for r in live.result().orderBy("price").collect()] == [15, 16, 17, 18, 3]


def test_a_stream_of_commits_drives_it(spark):
    t = VersionedTable.create(spark, new_path(spark, "versions"), spark.createDataFrame([(i, "a", float(i)) for i in range(8)], DDL), "id", buckets=4)
    live = LiveQuery(t, new_path(spark, "live"), {"price": {"gte": 5}}, fields=["id", "price"])
    live.advance()
    source, log, got = new_path(spark, "commits"), new_path(spark, "log"), []
    for price in (9.0, 1.0):
        version = t.begin().update(spark.createDataFrame([(2, "a", price)], DDL)).commit()
        spark.createDataFrame([(version,)], "version long").write.mode("append").parquet(source)
        stream = spark.readStream.schema("version long").parquet(source)
        follow(live, stream, lambda d, n: got.append([(r["id"], r["price"]) for r in d.collect()]), log).awaitTermination()
    assert got == [[(2, 9.0)], [(2, 9.0)]] and {r["id"] for r in live.result().collect()} == {5, 6, 7}


def test_refused(spark):
    t = VersionedTable.create(spark, new_path(spark, "versions"), spark.createDataFrame([(1, "a", 1.0)], DDL), "id", buckets=2)
    for how in ({"fields": ["nope"]}, {"order": [("nope", "asc")]}, {"limit": 0}):
        with pytest.raises(QueryError):
            LiveQuery(t, new_path(spark, "live"), {}, **how)
