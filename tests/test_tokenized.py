"""The search queries on full tokens against brute force."""

import math
from collections import Counter

import pytest

import __spark_entry__
from quern import queries
from quern.functions import text
from quern.operators import similarity
from quern.plans import search as plan

TEXTS = ["The café thing was naïve", "the THING was, was at joe@a.com 3.14", "cafe the getUserName été", "Straße und Übung the", None, "", "U.S.A. don't thing thinks was", "der Bär thing the"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("small"))
    rows = [(i, t, ["en", "fr"][i % 2], "a", 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, [float(i - k % 5) for k in range(64)]) for i in range(4, 12)], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


def brute(weights):
    """doc_id: (score, terms met) for {term: {token: weight}}."""
    docs = {i: text.tokens_of(t) for i, t in enumerate(TEXTS) if t is not None}
    df = Counter(w for words in docs.values() for w in set(words))
    mean, out = sum(map(len, docs.values())) / len(docs), {}
    for i, words in docs.items():
        parts = [(t, g * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * (n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words) / mean)) + 0.5)) for t, forms in weights.items() for w, g in forms.items() if (n := words.count(w))]
        if parts:
            out[i] = sum(p for _, p in parts), len({t for t, _ in parts})
    return out


EXACT = {t: {t: 1.0} for t in ("the", "thing", "was")}


def rows(spark, small, name):
    return [tuple(r) for r in __spark_entry__.queries()[f"{name}_full"](spark, small).collect()]


def test_index(spark, small):
    want = Counter((i, w) for i, t in enumerate(TEXTS) for w in text.tokens_of(t))
    assert sorted(rows(spark, small, "term_frequencies")) == sorted((i, w, n) for (i, w), n in want.items())
    df = Counter(w for _, w in want)
    assert {"cafe", "joe@a.com", "3.14", "usa", "dont", "strasse" if "strasse" in df else "straße"} <= set(df)
    assert dict(rows(spark, small, "doc_frequencies")) == df
    assert rows(spark, small, "index_report") == [("text", 7, len(df), sum(n == 1 for n in df.values()), len(want))]


def test_scores(spark, small):
    want = brute(EXACT)
    assert {i: (s, n) for i, s, n in rows(spark, small, "bm25_exact")} == {i: (pytest.approx(s, abs=1e-5), n) for i, (s, n) in want.items()}
    typo = brute({"thing": {"thing": 1.0, "think": 0.6, "thinks": 0.0}, "there": {}})
    assert {i: s for i, s, _ in rows(spark, small, "bm25_prefix_typo")} == pytest.approx({i: s for i, (s, _) in typo.items()}, abs=1e-5)
    every, rest = [i for i in want if want[i][1] == 3], sorted((i for i in want if want[i][1] < 3), key=lambda i: (-round(want[i][0], 9), i))
    assert sorted(i for (i,) in rows(spark, small, "search_threshold")) == sorted(every + rest[: math.ceil(len(rest) / 4)])
    share = lambda i: sum((a, b) in zip(w := text.tokens_of(TEXTS[i]), w[1:], strict=False) for a, b in (("the", "thing"), ("thing", "was"))) / 2
    assert dict(rows(spark, small, "proximity_rerank")) == pytest.approx({i: s * (1 + 0.5 * (share(i) if n > 1 else 0)) for i, (s, n) in want.items()}, abs=1e-5)
    assert dict(rows(spark, small, "search_facet")) == Counter(["en", "fr"][i % 2] for i, t in enumerate(TEXTS) if "the" in text.tokens_of(t))


def test_fusion(spark, small):
    words = {i: s for i, (s, _) in brute(EXACT).items()}
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    q = similarity.unit(queries._QVEC)
    near = {i: s for i in range(4, 12) if (s := sum(a * b for a, b in zip(unit([float(i - k % 5) for k in range(64)]), q, strict=True))) >= 0.1}
    want = {i: 0.5 * words.get(i, 0) / max(words.values()) + 0.5 * near.get(i, 0) / max(near.values()) for i in words.keys() | near.keys()}
    assert dict(rows(spark, small, "hybrid_fusion")) == pytest.approx(want, abs=2e-5)


def test_accents_meet(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for query in ("café", "cafe", "CAFÉ"):
        assert {r["doc_id"] for r in plan.search(docs, "doc_id", query, ["text"], exact=True).collect()} == {0, 2}


def test_entry_searches_full_tokens(spark, monkeypatch, small):
    monkeypatch.setattr(__spark_entry__, "table", lambda spark, folder, name: spark.createDataFrame([(1, "thing2 there"), (2, "thíng"), (3, "nothing")], "doc_id long, text string"))
    assert {r["doc_id"] for r in __spark_entry__.entry(spark).collect()} == {1, 2}


@pytest.mark.parametrize("how", [{"exact": True}, {}])
def test_a_query_splits_the_texts_once(spark, how):
    docs = spark.createDataFrame([(1, "The thing, théré"), (2, "things there the"), (3, None), (3, "Thing THE thing"), (4, "")], "doc_id long, text string")
    index = plan.Index(docs, "doc_id", ["text"])
    found = plan.scored(index, ["the", "thing"], **how)
    want = {1: 2, 2: 1, 3: 2} if how else {1: 2, 2: 2, 3: 2}
    assert {r["doc_id"]: r["hits"] for r in found.collect()} == want
    assert "EvalPython" not in found._jdf.queryExecution().toString()
    assert {(r["doc_id"], r["len"]) for r in index.lengths.collect()} == {(1, 3), (2, 3), (3, 3), (4, 0)}


def test_tokens_of_pieces_are_those_of_the_whole_text():
    for value, want in (("Straße, café́s ﬁne", ["straße", "cafes", "fine"]), ("a¨b", ["a", "b"]), ("ABC abc Abc aBc x1 1x.", ["abc", "abc", "abc", "abc", "a", "bc", "x1", "1x"]), ("-- ' .", [])):
        assert text.tokens_of(value) == want


def test_tokens_of_a_batch_are_not_all_held_at_once(monkeypatch):
    import pyarrow as pa

    held, most = [], []
    monkeypatch.setattr(text, "tokens_of", lambda x: held.append(x) or [x])
    monkeypatch.setattr(text.pa, "array", lambda rows, kind, real=pa.array: most.append(len(held)) or held.clear() or real(rows, kind))
    got = text.tokens.func(real_array := pa.chunked_array([[str(i) for i in range(501)]]).combine_chunks())
    assert got.to_pylist() == [[x] for x in real_array.to_pylist()] and max(most) <= 50
