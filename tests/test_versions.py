"""Versioned tables: whole commits, conflicts, replays, dying writes; JSON merge patches."""

import threading

import pytest
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.operators import writes
from quern.sources.durable import new_path
from quern.sources.versions import VersionedTable

DDL = "id long, name string, price double"


@pytest.fixture
def t(spark):
    rows = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(40)], DDL)
    return VersionedTable.create(spark, new_path(spark, "versions"), rows, "id", buckets=8, now=lambda: 1000)


def rows_of(df):
    return {r["id"]: (r["name"], r["price"]) for r in df.collect()}


def patch(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, price double")


def test_commit_is_whole_and_readers_keep_their_version(spark, t):
    before = t.read(0)
    got = t.begin().update(patch(spark, (1, 50.0))).delete(spark.createDataFrame([(2,), (99,)], "id long")).create(spark.createDataFrame([(100, "new", 1.0)], DDL)).commit("op")
    now = rows_of(t.read())
    assert got == t.version == 1 and now[1] == ("n1", 50.0) and 2 not in now and now[100] == ("new", 1.0) and len(now) == 40
    assert len(rows_of(before)) == 40 and rows_of(t.read(0))[1] == ("n1", 1.0)
    assert t.get(100).first()["name"] == "new"
    with pytest.raises(QueryError, match="entity_not_found"):
        t.get(2)
    log = {(r["id"], r["op"], r["field"], r["previous"], r["value"]) for r in t.changes().collect()}
    assert log == {(1, "update", "price", "1.0", "50.0"), (2, "delete", "name", "n2", None), (2, "delete", "price", "2.0", None), (100, "create", "name", None, "new"), (100, "create", "price", None, "1.0")}
    assert [(r["id"], r["deleted_at"]) for r in t.tombstones().collect()] == [(2, 1001)]
    assert {r["updated_at"] for r in t.read().where("id in (1, 100)").collect()} == {1001} and t.read().where("id = 3").first()["updated_at"] == 1000


def test_replay_changes_nothing(spark, t):
    assert t.begin().update(patch(spark, (1, 7.0))).commit("op") == 1
    assert t.begin().update(patch(spark, (1, 8.0))).commit("op") == 1
    assert t.version == 1 and rows_of(t.read())[1][1] == 7.0


def test_refused_steps_leave_no_trace(spark, t):
    for make in (lambda x: x.create(spark.createDataFrame([(3, "again", 0.0)], DDL)), lambda x: x.create(spark.createDataFrame([(300, "a", 0.0), (300, "b", 0.0)], DDL))):
        with pytest.raises(QueryError) as e:
            make(t.begin().update(patch(spark, (3, 0.5)))).commit()
        assert e.value.status == 409
    with pytest.raises(QueryError, match="validation_failed: positive"):
        t.begin().update(patch(spark, (3, -5.0))).commit(rules={"positive": F.col("price") >= 0})
    with pytest.raises(QueryError, match="operation_too_large"):
        t.begin().update(patch(spark, *((i, 0.0) for i in range(6)))).commit(most=5)
    with pytest.raises(QueryError, match="invalid_key"):
        t.begin().update(patch(spark, (None, 0.0))).commit()
    with pytest.raises(QueryError, match="table_exists"):
        VersionedTable.create(spark, t.path, t.read(), "id")
    assert t.version == 0 and rows_of(t.read())[3][1] == 3.0


def test_of_two_commits_on_the_same_rows_one_is_refused(spark, t):
    a, b = t.begin(), t.begin()
    a.update(patch(spark, (1, 10.0))).commit()
    with pytest.raises(QueryError) as e:
        b.update(patch(spark, (1, 20.0))).commit()
    assert e.value.status == 409 and rows_of(t.read())[1][1] == 10.0
    bucket = {r["id"]: r["b"] for r in t.read().select("id", t._bucket("id").alias("b")).collect()}
    other = next(i for i in range(40) if bucket[i] != bucket[1])
    c, d = t.begin(), t.begin()
    c.update(patch(spark, (1, 11.0))).commit()
    assert d.update(patch(spark, (other, 99.0))).commit() == 3  # other rows: goes on from the first
    now = rows_of(t.read())
    assert (now[1][1], now[other][1]) == (11.0, 99.0)
    clocks = [h["clock"] for h in t.history()]
    assert clocks == sorted(set(clocks))


def test_threads_commit_one_after_another(spark, t):
    done, lost = [], []

    def work(k):
        try:
            done.append(t.begin().update(patch(spark, (k, 500.0 + k))).commit())
        except QueryError as e:
            lost.append((k, e.status))

    threads = [threading.Thread(target=work, args=(k,)) for k in (0, 1, 2, 2)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert len(done) + len(lost) == 4 and len(set(done)) == len(done) and done and all(s == 409 for _, s in lost)
    assert t.version == len(done) and sum(v[1] >= 500 for v in rows_of(t.read()).values()) in (len(done), len(done) - 1)
    assert VersionedTable(spark, t.path).version == len(done)


def test_a_write_that_dies_leaves_the_old_version(spark, t, monkeypatch):
    def die(manifest):
        raise RuntimeError("killed")

    monkeypatch.setattr(t, "_link", die)
    with pytest.raises(RuntimeError):
        t.begin().update(patch(spark, (1, 77.0))).commit("op")
    again = VersionedTable(spark, t.path, now=lambda: 1000)
    assert again.version == 0 and rows_of(again.read())[1][1] == 1.0
    assert again.begin().update(patch(spark, (1, 78.0))).commit("op") == 1
    assert again.vacuum(keep=1, hours=0) == 2  # the dead write's data and changes
    assert rows_of(again.read())[1][1] == 78.0
    with pytest.raises(QueryError, match="unknown_version"):
        again.read(0)


def test_merge_patches(spark):
    kind = "id long, s struct<name:string,`p q`:struct<x:int,y:int>>, v double, l array<int>, updated_at long"
    rows = spark.createDataFrame([(1, ("a", (1, 2)), 5.0, [1], 10), (2, ("b", None), 6.0, None, 10), (3, None, 7.0, None, 10), (4, ("d", (3, 4)), 8.0, [1], 10), (5, None, None, None, 10)], kind)
    patches = [(1, '{"s": {"name": null, "p q": {"x": 9}}, "v": null}'), (2, '{"s": {"p q": {"y": 3}}, "l": [1, 2], "updated_at": 99}'), (3, '{"v": 7.0}'), (4, '{"s": null, "l": []}'), (9, "{}"), (5, '{"s": {"name": "new"}}')]
    got = writes.merged_json(rows, spark.createDataFrame(patches, "id long, patch string"), "id", "patch", F.lit(11)).orderBy("id").collect()
    plain = [(r["id"], r["s"] and (r["s"]["name"], r["s"]["p q"] and tuple(r["s"]["p q"])), r["v"], r["l"], r["updated_at"]) for r in got]
    assert plain == [(1, (None, (9, 2)), None, [1], 11), (2, ("b", (None, 3)), 6.0, [1, 2], 11), (3, None, 7.0, None, 10), (4, None, 8.0, [], 11), (5, ("new", None), None, None, 11)]
    for bad in ("[1]", "nope", '{"zz": 1}', '{"v": "abc"}', '{"s": 3}', '{"s": {"p q": {"x": "q"}}}', None):
        with pytest.raises(QueryError, match="invalid_patch"):
            writes.merged_json(rows, spark.createDataFrame([(1, bad)], "id long, patch string"), "id", "patch", F.lit(11))
    with pytest.raises(QueryError, match="two patches"):
        writes.merged_json(rows, spark.createDataFrame([(1, "{}"), (1, "{}")], "id long, patch string"), "id", "patch", F.lit(11))
