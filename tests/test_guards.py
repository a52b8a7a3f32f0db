"""Filters that reach the scan, marked fields, limits of the change log, seeded numbers."""

import pytest
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.functions import random
from quern.functions.text import tokens_of
from quern.operators import entity, facets, order
from quern.operators.where import marked, where
from quern.sources import objects
from quern.sources.tables import scan

NAN = float("nan")


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("guards"))
    rows = [(1, 5.0, [1.0, NAN], 1), (2, NAN, [9.0], 1), (3, None, None, 1), (4, 9.0, [NAN], 2)]
    spark.createDataFrame(rows, "id long, price double, many array<double>, k long").write.parquet(f"{at}/t.parquet")
    return at


def test_filters_on_doubles_reach_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = where(scan(spark, sf, "orders"), {"o_totalprice": {"gte": 100000, "lt": 300000}})._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_totalprice,100000.0)" in plan and "LessThan(o_totalprice,300000.0)" in plan


@pytest.mark.parametrize(("condition", "want"), [({"price": {"gt": 6}}, [4]), ({"price": {"gte": 5}}, [1, 4]), ({"price": {"lt": 6}}, [1]), ({"price": {"not_in": [5.0]}}, [4]), ({"price": {"not_in": []}}, [1, 4]), ({"not": {"price": {"gt": 6}}}, [1, 2, 3]), ({"many": {"gt": 2}}, [2]), ({"price": {"between": [5, 9]}}, [1, 4])])
def test_nan_is_absent_in_a_raw_scan(spark, at, condition, want):
    assert sorted(r["id"] for r in where(scan(spark, at, "t"), condition).collect()) == want


def test_orders_and_facets_of_a_raw_scan(spark, at):
    rows = scan(spark, at, "t")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(order.page(rows, [("price", "desc")], "id")) == [4, 1, 2, 3] and ids(order.page(rows, [("price", "asc")], "id")) == [1, 4, 2, 3]
    assert ids(order.after(rows, "id", order.cursor("price", "desc", 5.0, 1))) == [2, 3]
    assert sorted(ids(order.behind(rows, [("k", "asc"), ("price", "desc")], "id", {"k": 1, "price": 5.0, "id": 1}))) == [2, 3, 4]
    assert [r["count"] for r in facets.ranges(rows, "price", [(0, 6), (6, float("inf"))]).collect()] == [1, 1]


def test_marked_fields_are_refused(spark, at):
    rows = marked(marked(scan(spark, at, "t"), "many", vector=2), "k", carried=True)
    for use in (lambda: where(rows, {"many": {"gt": 1}}), lambda: facets.values(rows, "many"), lambda: order.page(rows, [("many", "asc")], "id")):
        with pytest.raises(QueryError, match="vector"):
            use()
    for use in (lambda: where(rows, {"not": {"k": 1}}), lambda: facets.values(rows, "k"), lambda: order.page(rows, [("k", "asc")], "id")):
        with pytest.raises(QueryError, match="carried_field_not_queryable"):
            use()
    assert where(rows, {"price": 5.0}).count() == 1


def test_limits_of_the_log(spark):
    log = spark.createDataFrame([(1, "f", "update", "a", "b", "op1", 10, "t"), (1, "g", "update", "c", "d", "op2", 20, "t"), (2, "f", "update", "x", "y", "op2", 30, "u")], entity.CHANGES + ", table string")
    assert [r["field"] for r in entity.history(log, 1, before=20).collect()] == ["f"] and len(entity.history(log, 1, limit=0).collect()) == 1
    assert [r["created_at"] for r in entity.since(log, 10, operation=" op2 ").collect()] == [20, 30]
    assert [r["created_at"] for r in entity.since(log, -5, table="u").collect()] == [30]
    for how, code in (({"blobs": ("g",)}, "revert_blob"), ({"most": 1}, "operation_too_large")):
        with pytest.raises(QueryError, match=code):
            entity.undo(log, "op2", **how)
    with pytest.raises(QueryError, match="operation_not_found"):
        entity.undo(log, "op9")
    assert entity.undo(log, "op1", blobs=("g",)).first()["value"] == "a"
    seen = spark.createDataFrame([(1, 7, "update", "a", 5), (2, 7, "update", None, 6)], "seq long, entity_id long, op string, before string, stamped long")
    row = entity.coalesced(seen).first()
    assert (row["before"], row["last_before"], row["stamped"], row["existed"]) == ("a", None, 6, True)


def test_stray_apostrophes_part_words():
    assert tokens_of("rockʼʼroll") == ["rock", "roll"] and tokens_of("ʼtwas donʼt ʼ") == ["twas", "dont"]


def plain_mulberry(a, n):
    for _ in range(n):
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = (a ^ a >> 15) * (a | 1) & 0xFFFFFFFF
        t = (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) & 0xFFFFFFFF) ^ t
    return (t ^ t >> 14) / 2**32


def test_seeded_numbers(spark):
    df = spark.createDataFrame([(s,) for s in (0, 1, 7, 0xFFFFFFFF)], "s long")
    got = df.select("s", *(random.mulberry(F.col("s"), n).alias(f"m{n}") for n in (1, 5))).collect()
    assert all(r[f"m{n}"] == plain_mulberry(r["s"], n) for r in got for n in (1, 5))
    words = spark.createDataFrame([("",), ("a",), ("foobar",)], "t string").select(random.fnv1a(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in words] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


def test_external_objects(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.bin").write_bytes(b"\x00\x01")
    (tmp_path / "two é.txt").write_text("two")
    found = objects.stored(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, "a/one.bin"), (2, "two é.txt"), (3, "none"), (4, None)], "id long, ref string")
    got = {r["id"]: r["object"] for r in objects.resolved(rows, "ref", found).collect()}
    assert bytes(got[1]["content"]) == b"\x00\x01" and got[2]["length"] == 3 and got[3] is None and got[4] is None
    plan = objects.resolved(rows, "ref", found, content=False)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1] or "content" not in plan


def test_one_clock_over_ranges(spark):
    rows = [(i, [5, 5, 900, 3, 40][i % 5] + i // 60 * 700) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = [r["stamp"] for r in entity.clocked(spark.createDataFrame(rows, "id long, at long"), "at", ["id"]).orderBy("id").collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = [], -(1 << 60)
    for _, at in rows:
        last = max(at, last + 1)
        want.append(last)
    assert got == want
