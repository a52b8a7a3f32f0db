"""Semantics that the registered queries do not reach: refusals, tokens, diffs, streams."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.functions import geo, scalars, text
from quern.operators import diff, facets, order, similarity
from quern.operators.where import where
from quern.sources.tables import drift, execute_many, schema_sql, validate
from quern.streaming import keyed

ROWS = [(1, 5.0, ["a", "b"], (47.0, 8.0)), (2, None, None, None), (3, -1.0, [], (0.0, 0.0)), (4, 9.0, ["a", None], (47.001, 8.0))]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, price double, tags array<string>, place struct<lat:double,lon:double>").cache()


CASES = [
    ({"price": 5.0}, [1]), ({"price": [5.0, 9.0]}, [1, 4]), ({"price": None}, []), ({"price": {"in": []}}, []), ({"price": {"not_in": []}}, [1, 3, 4]),
    ({"tags": "a"}, [1, 4]), ({"tags": {"contains_all": []}}, [1, 3, 4]), ({"tags": {"contains_all": ["a", "b"]}}, [1]), ({"tags": {"not_in": ["b"]}}, [3, 4]),
    ({"and": []}, []), ({"or": []}, []), ({"not": {"price": {"gt": 0}}}, [2, 3]), ({"not": {"not": {"price": {"gt": 0}}}}, [1, 4]), ({}, [1, 2, 3, 4]),
    ({"price": {"gt": 0, "lt": 6}}, [1]), ({"place": {"radius": {"center": [47.0, 8.0], "value": 0.2, "unit": "km"}}}, [1, 4]),
    ({"place": {"radius": {"center": [47.0, 8.0], "value": 0.2, "unit": "km", "inside": False}}}, [3]), ({"place": {"polygon": {"points": [[46, 7], [48, 7]]}}}, []),
]


@pytest.mark.parametrize(("condition", "ids"), CASES)
def test_where(df, condition, ids):
    assert sorted(r["id"] for r in where(df, condition).collect()) == ids


@pytest.mark.parametrize("bad", [{"nope": 1}, {"price": "5"}, {"price": {"contains_all": [1]}}, {"tags": {"between": ["a"]}}, {"place": {"near": {}}}, {"price": {"like": 1}}])
def test_where_refuses(df, bad):
    with pytest.raises(QueryError):
        where(df, bad)


def matches(row, node):
    """A plain evaluator for a few operators."""
    out = True
    for k, v in node.items():
        if k == "not":
            out &= not matches(row, v)
        elif k == "or":
            out &= any(matches(row, w) for w in v)
        elif k == "and":
            out &= bool(v) and all(matches(row, w) for w in v)
        else:
            x, op = row[k], next(iter(v))
            out &= x is not None and {"gt": lambda: x > v[op], "eq": lambda: x == v[op], "not_in": lambda: x not in v[op]}[op]()
    return out


leaf = st.one_of(*(st.fixed_dictionaries({c: st.one_of(st.fixed_dictionaries({"gt": st.integers(0, 3)}), st.fixed_dictionaries({"eq": st.integers(0, 3)}), st.fixed_dictionaries({"not_in": st.lists(st.integers(0, 3), max_size=2)}))}) for c in "ab"))
tree = st.recursive(leaf, lambda t: st.one_of(st.fixed_dictionaries({"not": t}), st.fixed_dictionaries({"or": st.lists(t, max_size=3)}), st.fixed_dictionaries({"and": st.lists(t, max_size=3)})), max_leaves=6)


@settings(max_examples=25, deadline=None)
@given(tree)
def test_where_against_a_plain_evaluator(spark, node):
    rows = [{"a": a, "b": b} for a in (None, 0, 2, 3) for b in (None, 1, 3)]
    got = where(spark.createDataFrame([(r["a"], r["b"]) for r in rows], "a long, b long"), node).collect()
    key = lambda r: (r["a"] is None, r["a"] or 0, r["b"] is None, r["b"] or 0)
    assert sorted(map(key, got)) == sorted(key(r) for r in rows if matches(r, node))


def test_filters_reach_the_scan(spark, sf):
    plan = where(spark.read.parquet(f"{sf}/orders.parquet"), {"o_orderstatus": ["F"], "o_totalprice": {"gt": 5}}).select("o_orderkey")
    text_of = plan._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderstatus" in text_of or "EqualTo(o_orderstatus" in text_of
    assert "GreaterThan(o_total" in text_of and "o_orderdate" not in text_of


def test_tokens():
    assert text.tokens_of("Café getUserHTTPServer U.S.A. don't") == ["cafe", "getuserhttpserver", "get", "user", "http", "server", "usa", "dont"]
    assert text.tokens_of("mail joe@a.com now, 3.14") == ["mail", "joe@a.com", "joe", "a", "com", "now", "3.14", "3", "14"]
    assert text.tokens_of(None) == [] and len(text.tokens_of("x" * 90)[0]) == 64
    assert text.variants("cities") == ["city"] and text.variants("thing") == ["things"] and text.variants("boxes") == ["box"] and text.variants("ab") == []
    assert [text.tolerance(t) for t in ("four", "fives", "ninechars", "abc12")] == [0, 1, 2, 0]


def test_simple_tokens_agree_with_the_pipeline(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '^[a-z \\n]+$'").select(text.tokens(F.col("text")).alias("a"), text.simple_tokens(F.col("text")).alias("b"))
    assert rows.where("a <> b").count() == 0


def test_quantized_lengths(spark):
    got = spark.range(70).select("id", text.quantized(F.col("id")).alias("q")).collect()
    assert all(r["q"] == (r["id"] if r["id"] < 32 else r["id"] >> 1 << 1 if r["id"] < 64 else r["id"] >> 2 << 2) for r in got)


def test_diff_gives_both_sides_back(spark):
    rows = spark.createDataFrame([("a b c\nd", "a x c\r\nd e"), ("", "new"), ("<b>", "<b>")], "o string, n string")
    ops = diff.script(diff.words(F.col("o")), diff.words(F.col("n")))
    got = rows.withColumn("ops", ops).select("o", "n", diff.side(F.col("ops"), "insert").alias("old"), diff.side(F.col("ops"), "delete").alias("new"), diff.html(F.col("ops")).alias("h")).collect()
    assert all(r["o"] == r["old"] and r["n"] == r["new"] for r in got)
    assert got[2]["h"] == "&lt;b&gt;" and got[1]["h"] == "<ins>new</ins>"


def test_refusals(spark, df):
    for call in (lambda: geo.metres(1, "parsec"), lambda: order.keys(df, [("x", "asc")], "id"), lambda: facets.values(df, "place"), lambda: facets.ranges(df, "price", []), lambda: similarity.unit([0.0]), lambda: execute_many(spark, [("drop table x",)]), lambda: validate(spark, "select nope from nothing")):
        with pytest.raises(QueryError):
            call()
    assert validate(spark, "select 1 as a") == ["a"] and schema_sql("t", spark.range(1)) == "CREATE TABLE t (id BIGINT NOT NULL)"
    assert drift(spark.range(1), spark.range(1).selectExpr("cast(id as string) id")) == [("id", "bigint", "string")]


def test_scalars(spark):
    r = spark.createDataFrame([("a_b", 2048, 112)], "s string, n long, k long").select(scalars.humanized(F.col("s")), scalars.storage(F.col("n")), scalars.ordinal(F.col("k")), scalars.base64url(F.encode("s", "UTF-8"))).first()
    assert tuple(r) == ("A B", "2.0 KB", "112th", "YV9i")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (1, "a2", 2), (2, "b", 1)], "id long, state string, version long").selectExpr("*", "timestamp_seconds(1700000000 + version) ts").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long, state string, version long, ts timestamp").parquet(src)
    q = keyed.first_ids(stream, "id", "ts").writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.table("firsts").collect()) == [1, 2]
    q = keyed.last_writes(stream, "id", "state", "version").writeStream.format("memory").queryName("lasts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert {(r["id"], r["state"]) for r in spark.table("lasts").collect()} == {(1, "a2"), (2, "b")}
    seen = []
    keyed.deliver(stream, lambda d, n: seen.extend(r["id"] for r in d.collect()), lambda d: d.where("id = 2"), str(tmp_path / "c3")).awaitTermination()
    assert seen == [2]
