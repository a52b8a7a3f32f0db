"""Writes, guards, pages and highlights: refusals and rules that the registered queries do not reach."""

import pytest
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.functions import scalars, text
from quern.operators import keyed, sync, writes
from quern.plans import store
from quern.sources.tables import execute_many, tagged

AT = 9


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1), (3, None, 1, 1)], "id long, v string, created_at long, updated_at long")


def test_refusals_of_writes(spark, rows):
    for call, status in (
        (lambda: writes.get(rows, "id", 8), 404),
        (lambda: writes.created(rows, rows.where("id = 1").select("id", "v"), "id", F.lit(AT).cast("long")), 409),
        (lambda: writes.created(rows, spark.createDataFrame([(7,), (7,)], "id long"), "id", F.lit(AT).cast("long")), 409),
        (lambda: writes.deleted(rows, spark.createDataFrame([(8,)], "id long"), "id", F.lit(AT).cast("long")), 404),
        (lambda: writes.transaction(rows, [("create", spark.range(5001))], "id", F.lit(AT).cast("long")), 400),
        (lambda: writes.transaction(rows, [("delete", rows.where("id = 1")), ("create", rows.where("id = 2").select("id", "v"))], "id", F.lit(AT).cast("long")), 409),
    ):
        with pytest.raises(QueryError) as e:
            call()
        assert e.value.status == status
    assert writes.get(rows, "id", 2).first()["v"] == "b" and rows.count() == 3


def test_a_patch_that_changes_nothing_keeps_the_stamp(spark, rows):
    patch = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (9, "y")], "id long, v string")
    got = {r["id"]: (r["v"], r["updated_at"]) for r in writes.patched(rows, patch, "id", F.lit(AT).cast("long")).collect()}
    assert got == {1: ("a", 1), 2: ("x", 9), 3: (None, 1)}
    kept = writes.patched(rows, patch, "id", F.lit(AT).cast("long"), readonly=("v",)).collect()
    assert sorted(r["updated_at"] for r in kept) == [1, 1, 1]


@pytest.mark.parametrize("sql", ["WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT x FROM a", "FROM (SELECT 1 AS x) INSERT INTO t SELECT x", "DROP TABLE t", "SET x = 1", "CREATE TABLE u AS SELECT 1", "SHOW TABLES"])
def test_only_queries_run_in_a_batch(spark, sql):
    spark.sql("create or replace temp view t as select 1 as x")
    with pytest.raises(QueryError) as e:
        execute_many(spark, [("select 1",), (sql,)])
    assert e.value.code == "exec_many_not_read_only"


def test_values_are_bound(spark):
    assert execute_many(spark, [("select ';x' as a",)])[0].first()["a"] == ";x"
    assert tagged(spark, "select ", 3, " + ", 4, " as n").first()["n"] == 7
    with pytest.raises(QueryError):
        execute_many(spark, [("selec 1",)])


def test_sessions_end_where_another_acts(spark):
    log = [(1, "a", 0, False), (2, "a", 10, False), (3, "b", 20, False), (4, "a", 30, True), (5, "a", 40, False), (6, "a", 140, False)]
    df = spark.createDataFrame([(0, *r) for r in log], "doc long, op long, who string, at long, mark boolean")
    got = keyed.sessions(df, "doc", "at", "op", 100, "who", "mark").orderBy("session").collect()
    assert [(r["who"], r["events"]) for r in got] == [("a", 2), ("b", 1), ("a", 1), ("a", 1), ("a", 1)]


def test_tombstones_under_the_cap_stay(spark):
    df = spark.createDataFrame([(i, 5) for i in range(10)], "id long, at long")
    kept, anew = sync.capped(df, "id", "at", 10)
    assert kept.count() == 10 and not anew
    kept, anew = sync.capped(df, "id", "at", 9)
    assert sorted(r["id"] for r in kept.collect()) == [5, 6, 7, 8, 9] and anew
    assert sync.resumed(7, 2, 2) == 7 and sync.resumed(7, 1, 2) == sync.resumed(7, None, 2) == 0


def test_formats_and_digests(spark):
    good = {"time": "23:59:59.5", "date": "2024-02-29", "datetime": "2024-02-29T23:59+01:00", "ipv4": "1.2.3.4", "ipv6": "::ffff:1.2.3.4", "base64": "YQ==", "color": "#Abc", "email": "a@b.co", "uuid": "00000000-0000-0000-0000-000000000000", "url": "https://a.b/c", "phone": "x\ny"}
    bad = {"time": "99:99", "date": "9999-99-99", "datetime": "2024-02-29", "ipv4": "1.2.3.256", "ipv6": "1::2::3", "base64": "YQ=", "color": "#abcd", "email": "a@b", "uuid": "12345678-1234-9234-8234-123456789abc", "url": "no url", "date ": "2024-01-01\n"}
    row = spark.range(1).select(*(scalars.of_format(F.lit(v), k).alias(k) for k, v in good.items())).first()
    assert all(row)
    row = spark.range(1).select(*(scalars.of_format(F.lit(v), k.strip()).alias(k) for k, v in bad.items())).first()
    assert not any(row)

    def plain(s):
        units, h = memoryview(s.encode("utf-16-le")).cast("H").tolist(), 5381
        for u in units:
            h = (h * 33 + u) % 2**32
        digits = ""
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return f"{digits}_{len(units)}"

    words = ["", "a", "naïve 😀 日本", "x" * 300]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", scalars.djb2(F.col("w")).alias("d"), scalars.character_signature(F.col("w")).alias("s"))
    for r in df.collect():
        mask = 0
        for c in map(ord, r["w"]):
            mask |= 1 << ((c ^ c >> 5) & 31)
        assert r["d"] == plain(r["w"]) and r["s"] == mask


def test_tokens_by_the_rules():
    assert text.tokens_of("foo-getUserData") == ["foo", "getuserdata", "get", "user", "data"]
    assert text.tokens_of("u.s.army a.b U.S.") == ["u", "s", "army", "ab", "us"]
    assert text.tokens_of("rock''n don't (o'k@x.org)") == ["rock", "n", "dont", "ok@x.org", "ok", "x", "org"]
    assert text.capped(["a", "b", "a", "c", "a"], 2) == ["a", "b", "a"]
    want = {"things": ["thing"], "bus": [], "class": [], "classes": ["class"], "day": ["days"], "city": ["cities"], "box": ["boxes"], "pies": ["pie"], "x1s": []}
    assert {w: text.variants(w) for w in want} == want


def test_an_index_of_several_values_and_a_rebuild(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Café one", ["red", "blue"]), (2, "two", None), (3, None, [None, "red"])], "id long, title string, tags array<string>")
    index = store.Store(spark, f"file://{tmp_path}/i", "id", ["title", "tags"], buckets=4)
    assert index.ensure(docs) and not index.ensure(docs) and index.version == 1
    assert {r["id"] for r in index.scores("red").collect()} == {1, 3}
    assert {r["id"] for r in index.scores("cafe").collect()} == {1}
    index.update(spark.createDataFrame([(1, "other", None), (4, "new", ["red"])], docs.schema))
    assert {r["id"] for r in index.scores("red").collect()} == {3, 4} and index.scores("cafe").count() == 0
    index.remove(spark.createDataFrame([(3,)], "id long"))
    assert {(r["field"], r["n_docs"]) for r in index.stats.collect()} == {("title", 3), ("tags", 1)}
    index.build(docs)
    assert index.version == 2 and {r["id"] for r in index.scores("red").collect()} == {1, 3}
    other = store.Store(spark, f"file://{tmp_path}/i", "id", ["title"], buckets=4)
    assert other.ensure(docs) and other.version == 3
    with pytest.raises(QueryError):
        other.scores("red", fields=["tags"])


def test_highlights():
    assert store.highlighted("The quick Brown fox", {"brown"}) == {"text": "The quick Brown fox", "ranges": [[10, 15]]}
    got = store.highlighted("word " * 60 + "needle here " + "tail " * 60, {"needle"}, 40)
    (a, b) = got["ranges"][0]
    assert got["text"][a:b] == "needle" and got["text"].startswith("…") and got["text"].endswith("…") and len(got["text"]) <= 44
    assert store.highlighted("nothing", {"x"}) is None and store.highlighted(None, {"x"}) is None


def test_pages(spark, rows):
    scores = rows.selectExpr("id", "1.0D as score")
    got, n = store.page(scores, rows, "id", [("v", "desc")], ("v",), limit=2)
    assert n == 3 and {r["id"] for r in got.collect()} == {1, 2}
    with pytest.raises(QueryError):
        store.page(scores, rows, "id", [("created_at", "asc")], ("v",))


def test_shortest_scripts():
    import random

    from quern.operators.diff import shortest

    random.seed(3)
    for _ in range(300):
        x, y = ([random.choice("abc") for _ in range(random.randrange(9))] for _ in range(2))
        ops = shortest(x, y)
        assert [t for k, ts in ops if k != "insert" for t in ts] == x and [t for k, ts in ops if k != "delete" for t in ts] == y
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        assert sum(len(ts) for k, ts in ops if k == "keep") == best[-1][-1]
        assert all(ops[i][0] != ops[i + 1][0] for i in range(len(ops) - 1))
    assert shortest(list("abcd"), list("wxyz"), 2) == [("delete", list("abcd")), ("insert", list("wxyz"))]


def test_scripts_of_long_texts_take_no_step_an_edit(monkeypatch):
    import random

    from quern.operators import diff

    random.seed(4)
    kept = lambda ops: sum(len(ts) for k, ts in ops if k == "keep")
    x, y = ([random.choice("abcdefgh") for _ in range(n)] for n in (400, 300))
    with monkeypatch.context() as m:
        m.setattr(diff, "BIT_PAIRS", 0)
        want = kept(diff.shortest(x, y))
    monkeypatch.setattr(diff, "_frontier", None)  # a step an edit; only stretches beyond BIT_PAIRS need them
    ops = diff.shortest(x, y)
    assert kept(ops) == want and [t for k, ts in ops if k != "insert" for t in ts] == x and [t for k, ts in ops if k != "delete" for t in ts] == y
    edits = len(x) + len(y) - 2 * want
    assert kept(diff.shortest(["<", *x, ">"], ["<", *y, ">"], edits)) == want + 2 and kept(diff.shortest(["<", *x, ">"], ["<", *y, ">"], edits - 1)) <= 20


def test_clusters_and_moves(spark):
    from quern.operators import diff

    samples = ["Don't stop 你好 🇨🇭🇩🇪 👩‍👩‍👧 ok_1!", "", None]
    got = spark.createDataFrame([(s,) for s in samples], "s string").select(diff.clusters("s").alias("t")).collect()
    assert ["".join(r["t"]) for r in got] == [s or "" for s in samples]
    assert got[0]["t"] == ["Don't", " ", "stop", " ", "你", "好", " ", "🇨🇭", "🇩🇪", " ", "👩‍👩‍👧", " ", "ok_1", "!"]
    old = spark.createDataFrame([(1, k, float(i), k) for i, k in enumerate("abcde")], "doc long, k string, at double, text string")
    new = spark.createDataFrame([(1, k, float(i), k.replace("d", "D")) for i, k in enumerate("bcaxd")], "doc long, k string, at double, text string")
    assert {r["k"]: r["status"] for r in diff.structured(old, new, "doc", "k", "at", "text").collect()} == {"a": "moved", "b": "unchanged", "c": "unchanged", "d": "changed", "e": "deleted", "x": "inserted"}


def test_migrations(spark, rows):
    from quern.sources import migrations as m

    steps = [m.Migration(1, "a", lambda t: {"r": m.drop_column(t["r"], "v")}), m.Migration(2, "b", lambda t: {"r": m.drop_column(t["r"], "v")}), m.Migration(3, "c", lambda t: {}), m.Migration(4, "d", lambda t: {}, True)]
    tables, record = m.run({"r": rows}, steps, m.Record())
    assert record.done == [1] and record.failed[0] == 2 and "v" not in tables["r"].columns
    assert [s for *_, s in m.status(steps, record)] == ["done", "failed", "pending", "preflight"]
    assert [n for n, e in m.check({"r": rows}, steps, m.Record()) if e] == [2]
    assert m.run({"r": rows}, steps, m.Record(), fresh=True)[1].done == [1, 2, 3]
    for bad in (lambda: m.rebuild_table(rows, {}, True), lambda: m.run({}, [steps[0], steps[0]], m.Record())):
        with pytest.raises(QueryError):
            bad()


def test_sort_keys(spark):
    from quern.functions.keys import between, key_between

    low, high = None, None
    for k in range(200):
        mid = between(low, high)
        assert (low or "") < mid and (high is None or mid < high)
        low, high = (mid, high) if k % 3 else (low, mid)
    for bad in (("b", "a"), ("a", "a"), ("a0", None), ("é", None)):
        with pytest.raises(QueryError):
            between(*bad)
    df = spark.createDataFrame([("A", "B"), (None, "A"), ("z", None)], "a string, b string").select("a", "b", key_between("a", "b").alias("m"))
    assert all((r["a"] or "") < r["m"] and (r["b"] is None or r["m"] < r["b"]) for r in df.collect())


def test_hooks_and_embedders(spark, rows):
    from quern.operators.hooks import Hooks, embedded

    hooks = Hooks()
    hooks.add("before", "create", lambda d: d.withColumn("v", F.upper("v")))
    hooks.add("after", "create", lambda d: d.where("v is not null"))
    assert [r["v"] for r in hooks.run("create", rows, lambda d: d.orderBy("id")).collect()] == ["A", "B"]
    with pytest.raises(QueryError):
        hooks.add("around", "create", lambda d: d)
    got = embedded(rows, "v", lambda ts: [[float(len(t)), 1.0] for t in ts], 2).orderBy("id").collect()
    assert [r["embedding"] for r in got] == [[1.0, 1.0], [1.0, 1.0], None]
    with pytest.raises(Exception, match="invalid_vector"):
        embedded(rows, "v", lambda ts: [[float("inf"), 1.0] for _ in ts], 2).collect()
