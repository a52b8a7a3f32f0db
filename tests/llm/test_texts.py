"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quern.errors import QueryError
from quern.llm import blocks, bpe_codec, graph, language_id, mixing, ngram_join, quality, queries, substring_dedup, texts, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, n string"


def make(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


def words(text):
    return (text or "").encode().split()


PASSAGE = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="module")
def rows():
    body = lambda k, n=80: " ".join(f"w{k}x{i}" for i in range(n))
    near = body(1).split()
    near[40] = "changed"
    chain = [" ".join(f"c{i}" for i in range(a, a + 60)) for a in (0, 6, 12, 18)]
    out = [
        (1, body(1), "en", "a", 1), (2, body(1), "en", "b", 2), (3, " ".join(near), "de", None, 3), (4, None, None, "a", None), (5, "", "en", "a", 0),
        (6, "one two", "en", "a", 7), (7, "ONE\tTwo", "fr", "b", 7), (8, " \n ", "en", "c", 3), (9, body(2) + " " + PASSAGE, "en", "c", 9),
        (10, PASSAGE + "\n" + body(3), "de", "c", 9), (11, "a b c d e f", "en", "a", 1), (12, "a b c d e f g", "en", "a", 1), (13, "same " * 70, "en", "a", 1),
        (14, body(4, 30_000), "en", "a", 1), (15, "été ß 日本  x 😀 don't 12,5", "fr", "b", 4), (16, "%%% 123 ***", "en", "b", 1), (None, "no id at all here now", "en", "b", 1),
        (17, "dup row", "en", "a", 1), (17, "dup row", "en", "a", 1), (17, "another text of the same id", "en", "a", 1), (18, "<|endoftext|> in text", "en", "a", 1), (19, "DON'T can''s !'re x1234y 'S a\x00b __A--b <|no", "en", "a", 1),
    ]
    return out + [(30 + i, c, "en", "d", 1) for i, c in enumerate(chain)]


def test_jaccard_components(spark, rows):
    sets = []
    for r in rows:
        w = [x.decode().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(r[1])]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append((r[0] is not None, r[0] or 0))
    want = Counter((r[0], len(s), (lambda m: m[1] if m[0] else None)(min(least[top(i)])) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(make(spark, rows)).collect()) == want


def test_light_pairs_by_subsets():
    assert ngram_join.overlap(3, 4) == 3 and ngram_join.overlap(4, 4) == 4
    assert (4, 3, 1) in ngram_join.subsets(3, 8) and (3, 3, 4) in ngram_join.subsets(4, 8)


def brute_windows(rows, size=20):
    seen, out = {}, []
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    kept = {}
    for has, i, text in order:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen.setdefault(tuple(w[k : k + size]), (i, k)) != (i, k):
                gone[k : k + size] = [True] * size
        kept[i if has else None, text] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    for r in rows:
        out.append((r[0], *kept[r[0], r[1] or ""]))
    return Counter(out)


def test_substring_dedup(spark, rows):
    got = substring_dedup.dedup_text(make(spark, rows))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == brute_windows(rows)
    assert {"lang", "score"} <= set(got.columns)


def test_borders_repeat_inside_equal_windows():
    rng = np.random.default_rng(5)
    window = rng.integers(0, 2**63, 20, dtype=np.uint64)
    seen = set()
    for _ in range(50):
        left, right = (rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64) for _ in range(2))
        text = np.concatenate([left, window, right])
        start = substring_dedup.borders(text, np.array([0, len(text)]))
        inside = start[(start >= len(left) + 7) & (start <= len(left) + 13)] - len(left)
        seen.add(tuple(inside.tolist()))
    assert len(seen) == 1 and seen.pop()


@pytest.mark.parametrize("letters", [2**63, 3, 1])
def test_equal_windows_share_their_first_phrase(letters):
    rng = np.random.default_rng(9)
    kinds = rng.integers(0, 2**63, letters, dtype=np.uint64) if letters < 9 else None
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) if kinds is None else kinds[rng.integers(0, letters, n)]
    for _ in range(20):
        window, seen = draw(20), set()
        for _ in range(30):
            left, right = draw(rng.integers(0, 30)), draw(rng.integers(0, 30))
            text = np.concatenate([draw(25), left, window, right])
            start, name = substring_dedup.phrases(text, np.array([0, 25, len(text)]))
            at = 25 + len(left)
            k = int(np.searchsorted(start, at + substring_dedup.REACH))
            assert at + 3 <= start[k] <= at + 6
            seen.add((int(start[k]) - at, int(name[k])))
        assert len(seen) == 1


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, rows):
    path, t = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    bpe_codec.encode(make(spark, rows), path).count()  # the same corpus again, in one session
    got = bpe_codec.decode(bpe_codec.encode(make(spark, rows), path), path).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_token_files_round_trip(spark, rows, tmp_path):
    t = library("word_bpe_49k.json")
    docs = make(spark, rows)
    token_files.write(docs, f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"), end=2, vocabulary=49_408)
    got = token_files.read(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    want = Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys)


def test_mixing_meets_targets(spark):
    docs = spark.createDataFrame([(i, "x " * (1 + i % 9), "abcde"[min(i % 7, 4)] if i % 11 else None) for i in range(900)], "doc_id long, text string, source string")
    got, sizes, quotas = mixing.mix(docs, mixing.cycle(5, 2, 1))
    rows = got.collect()
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["times"] <= 3
        taken[r["sources"][0]] += r["size"] * r["times"]
    assert all(abs(taken[s] - q) <= 10 for s, q in quotas.items()) and sum(quotas.values()) == pytest.approx(sum(sizes.values()))
    again, *_ = mixing.mix(docs, mixing.cycle(5, 2, 1))
    assert {r["doc_id"]: r["times"] for r in again.collect()} == {r["doc_id"]: r["times"] for r in rows}
    assert mixing.mixed(docs, mixing.cycle(5, 2, 1)).count() == sum(r["times"] for r in rows)


def test_flow_prefers_spread_over_repetition():
    assert mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 15, "b": 5}) == {("a",): 10, ("a", "b"): 10}
    assert mixing.targets({"a": 100, "b": 1}, {"a": 1, "b": 9}) == {"a": 98.0, "b": 3.0}


def test_quality_on_held_out_labels(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op1_quality(spark, sf).collect()
    assert len(got) == 200 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    known = [(r["score"], labels[r["doc_id"]]) for r in got if r["doc_id"] in labels]
    good, bad = ([s for s, y in known if y == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_quality_without_labels(spark, rows):
    docs = make(spark, rows)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, none)).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {0.5}


def test_language_of_held_out_documents(spark):
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in held]) > 0.97


def test_language_mixture_and_unknown(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs)
    one = {k: docs.where(f"lang = '{k}' and n_chars > 1500").first()["text"][:1500] for k in ("en", "de")}
    mixed = spark.createDataFrame([(1, one["en"] + " " + one["de"]), (2, one["de"]), (3, None), (4, "12 %%"), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(mixed, model).collect()}
    assert got[1]["langs"] == ["de", "en"] and got[2]["langs"] == ["de"]
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3
    assert language_id.identify(make(spark, rows), model).count() == len(rows)


def test_join_on_other_word_counts(spark):
    # One word of thirty changed: 25 of 31 sets of 3 words in common, but 21 of 31 sets of 5 words.
    pairs = [[f"{p}w{i}" for i in range(30)] for p in range(6)]
    texts = [" ".join(w) for a in pairs for w in (a, [*a[:15], "other", *a[16:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs, words=3).collect()}
    assert len(set(got.values())) == 6 and all(got[i] == got[i + 1] for i in range(0, 12, 2))


def test_short_windows_are_refused(spark):
    with pytest.raises(QueryError):
        substring_dedup.dedup_text(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), window=19)


def test_language_mixture_of_all_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs)
    one = {k: docs.where(f"lang = '{k}' and n_chars > 2000").orderBy("doc_id").first()["text"] for k in model[0]}
    cut = lambda k, n: one[k][: one[k].rindex(" ", 0, n)]
    assert model[0] == ["de", "en", "es", "fr"]
    mixed = spark.createDataFrame([(i, " ".join(cut(k, 1600 if k == most else 800) for k in model[0])) for i, most in enumerate(model[0])], "doc_id long, text string")
    for r in language_id.identify(mixed, model).collect():
        assert r["langs"] == model[0] and r["lang_pred"] == model[0][r["doc_id"]]
        assert 0.33 < r["score"] < 0.47 and all(0.13 < s < 0.27 for s in r["shares"] if s != r["score"])
    docs = mixed.selectExpr("doc_id", "text", "cast(null as string) lang").union(docs.select("doc_id", "text", "lang"))
    assert corpus_pipeline.language(spark, docs, "").where("doc_id < 4").join(mixed, ["doc_id", "text"]).count() == 0


@pytest.mark.parametrize("rows_of", ["empty", "odd"])
def test_empty_tables_and_odd_rows(spark, rows, rows_of, tmp_path):
    docs = make(spark, [] if rows_of == "empty" else [(None, None, None, None, None), (1, "", None, None, None)])
    n = docs.count()
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert ngram_join.join(docs).count() == n
    assert substring_dedup.dedup_text(docs).count() == n
    assert bpe_codec.decode(bpe_codec.encode(docs, path), path).count() == n
    assert mixing.mix(docs, mixing.cycle(5, 2, 1))[0].count() == n
    assert language_id.identify(docs, language_id.learn(docs)).count() == n
    token_files.write(docs, f"file://{tmp_path}/e", public_tokenizers.path("word_bpe_49k.json"), end=2)
    assert token_files.read(spark, f"file://{tmp_path}/e").count() == n
    assert all(stage(spark, docs, "").count() <= n for _, stage in corpus_pipeline.STAGES)


def test_pipeline_stages_against_brute_force(spark, rows):
    docs = make(spark, rows).drop("ids", "score", "n")
    stay = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    ids = [r["doc_id"] for r in stay]
    assert 2 not in ids and 3 not in ids and 7 not in ids and {1, 4, 5, 6, 9, 10, 11} <= set(ids) and ids.count(17) == 2
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.passages(spark, docs, "").collect()}
    assert 2 not in cut and PASSAGE in cut[9] and PASSAGE not in cut[10] and cut[4] is None
    last = corpus_pipeline.tokens(spark, docs, "")
    assert last.where("not round_trip").count() == 0 and last.count() == len(rows)


def test_digests_of_queries(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    t, u = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    pack = lambda ids: np.array(ids, "<u4").tobytes()
    for r in queries.op2_bpe_codec(spark, sf).collect():
        ids = t.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(pack(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in queries.op6_token_files(spark, sf).collect():
        assert r["ids_crc32"] == zlib.crc32(pack(u.encode(docs[r["doc_id"]], add_special_tokens=False).ids + [2]))
    total = sum(len(re.findall(rb"[^\x20\x09-\x0D]+", x.encode())) for x in docs.values())
    got = queries.op7_mixing(spark, sf)
    assert got.agg(F.sum("size")).first()[0] == total
    source = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    for r in got.join(source, "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r["t"] - r["target"]) <= 0.1 * r["target"]


def brute_components(texts):
    """Size of each text's set and the least number of its component."""
    sets = [set(zip(*(t.lower().split()[i:] for i in range(5)), strict=False)) if len(t.split()) >= 5 else {tuple(t.lower().split())} - {()} for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def test_short_texts_link_as_brute_force_says(spark):
    rng = np.random.default_rng(17)
    texts = ["a b c d e f g x", "a b c d e f g y", "k1 k2 k3 k4 k5 k6 k7 k8 k9", "k1 k2 k3 k4 k5 k6 k7 k8 other"]
    for k in range(60):
        base = [f"{k}w{i}" for i in range(rng.integers(5, 21))]
        texts.append(" ".join(base))
        for _ in range(rng.integers(1, 6)):
            other = list(base)
            for _ in range(rng.integers(0, 3)):
                at, way = rng.integers(0, len(other) + 1), rng.integers(0, 3)
                other[at : at + (way > 0)] = [f"new{rng.integers(0, 5)}"] * int(way < 2)
            texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
    want = dict(enumerate(brute_components(texts)))
    assert got == want and len({want[i] for i in range(4)}) == 4


@pytest.mark.parametrize("boundary", [0, 3, 5, 9, 14])
def test_any_boundary_gives_the_same_components(spark, monkeypatch, boundary):
    monkeypatch.setattr(ngram_join, "boundary_of", lambda *_: boundary)
    rng = np.random.default_rng(5)
    texts = []
    for k in range(12):
        base = [f"{k}v{i}" for i in range(rng.integers(6, 19))]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join([*base, "end"]), " ".join(["x", *base[1:]]), " ".join([*base[:-1], "z"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def greedy(rows, rest):
    """Keys that a walk in the order of the draws takes."""
    by_draw = defaultdict(list)
    for key, draw, size in rows:
        by_draw[draw].append((key, size))
    out = set()
    for draw in sorted(by_draw):
        total = sum(s for _, s in by_draw[draw])
        if 0 < total <= rest:
            rest -= total
            out |= {k for k, _ in by_draw[draw]}
    return out


@pytest.mark.parametrize("bins", [1 << 14])
def test_mixing_takes_what_a_greedy_walk_takes(spark, monkeypatch, bins):
    monkeypatch.setattr(mixing, "BINS", bins)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 1 << 62)), int(rng.choice([0, 1, 3, 50, 700]))) for i in range(200)]
    df = spark.createDataFrame([(0, d, s) for _, d, s in rows], "pattern int, draw long, size long")
    for rest in (49, 5003):
        taken = {i for i, d, s in rows for _, low, high, most in mixing.fill(df, {0: rest}, 0.0) if low <= d < high and 0 < s <= most}
        assert taken == greedy(rows, rest)


def test_mixing_of_overlapping_sources(spark):
    members = [["a"], ["b"], ["a", "b"], ["b", "c"], [None], [], None]
    rows = [(i, "w " * (1 + i % 13), members[i % 7]) for i in range(700)] + [(0, "w ", ["a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got, sizes, quotas = mixing.mix(docs, mixing.cycle(5, 2, 1), near=0.0)
    taken = Counter()
    for r in got.collect():
        taken[tuple(r["sources"] or ())] += r["size"] * r["times"]
        assert r["times"] <= 3 and (r["sources"] or not r["times"])
    flow = mixing.route({k: n for k, n in Counter({tuple(r["sources"] or ()): 0 for r in got.collect()}).items()}, {})
    assert set(flow) == {tuple(m or ()) if not m else tuple(sorted(m, key=lambda s: (s is None, s or ""))) for m in members}
    assert abs(sum(taken.values()) - sum(quotas.values())) <= 13 * len(taken)
    assert taken[("a",)] + taken[("a", "b")] >= quotas["a"] - 26


def test_flow_against_exhaustive_search():
    rng = np.random.default_rng(6)
    for _ in range(40):
        kinds = [("a",), ("b",), ("a", "b")]
        patterns = {p: int(rng.integers(1, 4)) for p in kinds if rng.random() < 0.8} or {("a",): 2}
        quotas = {"a": int(rng.integers(0, 7)), "b": int(rng.integers(0, 7))}
        best = None
        arcs = [(p, s) for p in patterns for s in p]
        cost_of = lambda n, size: sum(2 * (k // size) + 1 for k in range(n))
        for amounts in np.ndindex(*(3 * patterns[p] + 1 for p, _ in arcs)):
            used, met = Counter(), Counter()
            for (p, s), n in zip(arcs, amounts, strict=True):
                used[p] += n
                met[s] += n
            if all(used[p] <= 3 * patterns[p] for p in patterns) and all(met[s] <= quotas[s] for s in quotas):
                value = (-sum(amounts), sum(cost_of(used[p], patterns[p]) for p in patterns))
                best = min(best, value) if best else value
        got = mixing.route(patterns, quotas)
        assert (-sum(got.values()), sum(cost_of(n, patterns[p]) for p, n in got.items())) == best


def test_ftrl_against_plain_updates():
    rng = np.random.default_rng(3)
    size = (1 << quality.BITS) + 1
    model = quality.Ftrl(np.zeros(size), np.zeros(size))
    z, n, weight = defaultdict(float), defaultdict(float), {}

    def w(i):
        rate = (quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - (quality.L1 if z[i] > 0 else -quality.L1)) / rate

    for _ in range(200):
        i, y = rng.choice(50, 6, replace=False), float(rng.integers(0, 2))
        x = rng.random(6)
        model.step(i, x, y)
        old = {k: w(k) for k in i.tolist()}
        p = 1 / (1 + np.exp(-sum(old[k] * v for k, v in zip(i.tolist(), x.tolist(), strict=True))))
        for k, v in zip(i.tolist(), x.tolist(), strict=True):
            g = (p - y) * v
            z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / quality.ALPHA * old[k]
            n[k] += g * g
        weight = {k: w(k) for k in range(50)}
    assert np.allclose(model.weights(np.arange(50)), [weight[k] for k in range(50)])
    again = quality.Ftrl(model.weights(np.arange(size)), model.n)  # the next pass goes on from here
    assert np.allclose(again.weights(np.arange(50)), model.weights(np.arange(50)))


def test_quality_on_held_out_rows_only(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op1_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r["score"] for r in rows if labels[r["doc_id"]] == y] for y in (1, 0))
    assert len(rows) > 30 and np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95


def test_quality_learns_word_order(spark):
    rng = np.random.default_rng(0)
    texts = []
    for i in range(600):
        words = [f"w{k}" for k in rng.permutation(12)]
        at = int(rng.integers(0, 11))
        words[at : at + 2] = ["alpha", "beta"] if i % 2 else ["beta", "alpha"]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, None), (5, 0), (5, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert np.mean([(got[i] > 0.5) == bool(i % 2) for i in range(400, 600)]) > 0.95


def test_mixture_against_plain_em(spark):
    rng = np.random.default_rng(1)
    like = rng.dirichlet(np.ones(40), 3)
    table = np.log(np.pad(like, ((0, 0), (0, (1 << language_id.BITS) - 40)), constant_values=1e-9)).astype(np.float32)
    code = np.concatenate([rng.choice(40, 300, p=like[k]) for k in (0, 1)]).astype(np.uint32)
    begins = np.arange(0, 600, 3)
    share, size = language_id.mixtures(code, begins, np.zeros(200, np.int64), 1, table)
    word = np.exp(np.add.reduceat(table[:, code].astype(float), begins, axis=1).T)
    pi = np.ones(3) / 3
    for _ in range(3000):
        r = pi * word
        pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    two = np.argsort(-pi)[:2]
    pi = np.zeros(3)
    pi[two] = 0.5
    for _ in range(3000):
        r = pi * word
        pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    assert size[0] == 2 and set(np.flatnonzero(share[0])) == set(two.tolist()) and np.allclose(share[0], pi, atol=0.02)


def test_substring_dedup_without_broadcasts(spark, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", 0)
    got = substring_dedup.dedup_text(make(spark, rows))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == brute_windows(rows)


def thue_morse(n):
    """Two complementary words whose polynomial sums modulo 2^64 are equal from 1,024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_fingerprints_of_complementary_words(n):
    a, b = thue_morse(n)
    digests, first = texts.word_digests(pa.array([f"{a} {b} {a}", "x" * n, f"{b}"]))
    assert first.tolist() == [0, 3, 4, 5] and (digests[0] == digests[2]).all() and (digests[1] == digests[4]).all()
    assert len({tuple(d) for d in digests.tolist()}) == 3 and digests[0, 0] != digests[1, 0]


def plain_digest(word):
    """One span, in whole numbers."""
    low = (1 << 64) - 1

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & low
        return x ^ x >> 31

    if len(word) > texts.LONG_BYTES:
        return tuple(np.frombuffer(hashlib.blake2b(word, digest_size=16).digest(), "<u8").tolist())
    keys = [mix(k) for k in range(1, 9)]
    h = [mix(len(word) + keys[6] & low), mix(len(word) + keys[7] & low)]
    for at in range(0, max(len(word), 1), 16):
        w = [int.from_bytes(word[at + k : at + k + 8], "little") for k in (0, 8)]
        a, b = h[0] ^ w[0], h[1] ^ w[1]
        for k in keys[:4]:
            a, b = b, a ^ mix(b + k & low)
        h = [a ^ w[0] ^ mix(h[1] + keys[4] & low), b ^ w[1] ^ mix(h[0] + keys[5] & low)]
    return tuple(h)


@pytest.mark.parametrize("piece", [5, 1 << 18])
def test_fingerprints_of_spans(monkeypatch, piece):
    monkeypatch.setattr(texts, "PIECE_BYTES", piece)
    text = "one two  one été " + " ".join("y" * n for n in (7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 500)) + " z one"
    got, _ = texts.word_digests(pa.array([text, "one"]))
    assert [tuple(d) for d in got.tolist()] == [plain_digest(w) for w in [*text.encode().split(), b"one"]]
    data = np.frombuffer(b"abab", np.uint8)
    assert texts.span_hashes(data, np.array([0, 0, 2, 4]), np.array([0, 2, 4, 4])).tolist() == [plain_digest(w)[0] for w in (b"", b"ab", b"ab", b"")]
    assert len({plain_digest(b"x\0" * n) for n in range(9)} | {plain_digest(b"x" + b"\0" * n) for n in range(1, 40)}) == 9 + 39 - 1


def test_complementary_words_are_no_copies(spark):
    a, b = thue_morse(2048)
    fill = " ".join(f"w{i}" for i in range(19))
    docs = make(spark, [(1, f"{fill} {a}", "en", "a", 1), (2, f"{fill} {b}", "en", "a", 1), (3, a, "en", "a", 1), (4, b, "en", "a", 1)])
    got = {r["doc_id"]: r for r in substring_dedup.dedup_text(docs).collect()}
    assert all(r["n_removed"] == 0 for r in got.values())
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs.where("doc_id > 2")).collect()} == {3: 3, 4: 4}


def test_flow_without_a_quota():
    assert mixing.route({("a",): 5, ("a", "b"): 4}, {"b": 3}) == {("a",): 0, ("a", "b"): 3}


def test_platt_scaling():
    rng = np.random.default_rng(1)
    m = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(3 * m - 1)))).astype(float)
    a, b = quality.platt(m, y)
    assert abs(a - 3) < 0.3 and abs(b + 1) < 0.2
    assert quality.platt(-m, y) == (1.0, 0.0) and quality.platt(np.array([-1.0, 1.0]), np.array([0.0, 1.0]))[0] > 0


def test_word_coder_sends_only_parts_of_latin_words_to_the_model(monkeypatch):
    work = token_files.WordCoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180))] + list("''stremvld   \t\n")
    latin = ["".join(rng.choice(letters, 40)).replace("İ", "").replace("<|", "") for _ in range(500)]
    odd = ["İstanbul", "a<|endoftext|>b", "ƁȺ", "été", "你好 x\u0085y z", "ΣΣ"]
    expected = {t: np.array(work.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in latin + odd}
    assert work.encode(latin + odd) == list(expected.values())  # odd words of the same batch do not spoil the others
    fresh = token_files.WordCoder(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(fresh, "library", None)  # no word is a text of its own for the library
    assert fresh.encode(latin) == [expected[t] for t in latin]


def test_mixture_does_not_shuffle_texts(spark):
    docs = spark.createDataFrame([(i, "x " * (1 + i % 9), "abcde"[i % 5], i) for i in range(900)], "doc_id long, text string, source string, size int")
    times, _, _ = mixing.mix(docs, mixing.cycle(5, 2, 1))
    found = mixing.mixed(docs, mixing.cycle(5, 2, 1))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert Counter(r["doc_id"] for r in found.collect()) == {r["doc_id"]: r["times"] for r in times.collect() if r["times"]}
    assert found.columns == docs.columns and all(r["size"] == r["doc_id"] for r in found.collect())


def test_units_are_cut_many_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)
    letters = [chr(c) for c in range(0x20, 0x250)] + list("''stremvld 12 \n \t") * 3
    units = {u for _ in range(2000) for u in bpe_codec.UNITS.findall("".join(rng.choice(letters, 20)))} | {"\nx", " '", "it's"}
    expected = {u: bpe_codec.PRETOKENS.findall(u) for u in units}
    plain = {u for u in units if bpe_codec.PLAIN.fullmatch(u)}
    for some in (units, plain):
        if some is plain:
            monkeypatch.setattr(bpe_codec, "PRETOKENS", None)  # of these none is cut alone
        ordered, cut = bpe_codec.pretokens(some)
        assert set(ordered) == some and cut == [w for u in ordered for w in (*expected[u], bpe_codec.END)]


def test_codec_without_a_string_for_each_unit(monkeypatch):
    path, t = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    white = [" ", "\n", "\t", "\x1c", *map(chr, bpe_codec.WIDE.tolist())]
    rng = np.random.default_rng(7)
    letters = white + list("aéñ'1,.—你🙂\x00ÂáâãÇ‐᠎")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)]
    data, borders = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in texts)])
    found, codes = bpe_codec.distinct(data, bpe_codec.unit_edges(data, borders))
    assert found.take(codes).to_pylist() == [u for x in texts for u in bpe_codec.UNITS.findall(x)]
    mark = "<|endoftext|>"
    texts += [None, "", mark, f"a  {mark} b{mark}{mark}", "x <|endof", "text|>", f"<|endof{mark}", "text|>", "tail<|endof", f"text|>{mark}", "thing " * 300, "q" * 200]
    monkeypatch.setattr(bpe_codec, "UNITS", None)
    work = bpe_codec.Codec(path, None)
    for column in (pa.array(texts), pa.array(["before", *texts])[1:]):
        ids, n = work.encode(column)
        expected = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == expected and n.tolist() == list(map(len, expected))
        assert bpe_codec.decoded_all(ids, work.merges).to_pylist() == [x or "" for x in texts]
    monkeypatch.setattr(bpe_codec, "MEMO_BYTES", 4000)  # generations follow each other
    work.forget()
    for at in range(0, len(texts), 50):
        assert work.encode(pa.array(texts[at : at + 50], pa.string()))[0].to_pylist() == ids[at : at + 50].to_pylist()
    single = work.merges.single[list("é你".encode())].tolist()
    cut = pa.array([np.array(x, "<u4").tobytes() for x in (single[:1], single[1:], [], single[2:4])])
    assert bpe_codec.decoded_all(cut, work.merges).to_pylist() == ["�", bytes("é你".encode()[1:]).decode("utf-8", "replace"), "", "é你".encode()[2:4].decode("utf-8", "replace")]


def test_places_of_keys():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 62, 5000))
    places = bpe_codec.Places(rng.permutation(keys))
    assert (places.keys[places.of(keys)] == keys).all()
    assert (places.of(keys + 1) == np.where(np.isin(keys + 1, keys), places.of(keys + 1), len(keys))).all()
    assert (bpe_codec.Places(keys[:0]).of(keys) == 0).all()


def test_word_coder_looks_up_distinct_words_once():
    class Seen(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

    work = token_files.WordCoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(9)
    letters = list("aé ñ'1,\n\t\v\f\r你🙂\x00\x1c") + ["the ", "\u0085", " ", " ", "　"]
    rows = [None, "", "  ", *("".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(400)), "again and again " * 5000]
    work.memo = Seen()
    found = work.encode_column(pa.array(["before", *rows])[1:], b"\2\0\0\0")
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [[*work.library.encode(x or "", add_special_tokens=False).ids, 2] for x in rows]
    assert work.memo.asked == len(work.memo)
    assert work.encode_column(pa.array([], pa.string())) == [] and work.encode([None, "again"])[0] == b""


def test_codec_round_trip_in_one_worker(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = make(spark, rows)
    one = bpe_codec.encode(docs, path, back=True)
    two = bpe_codec.decode(bpe_codec.encode(docs, path), path)
    assert Counter(map(repr, one.select(*two.columns).collect())) == Counter(map(repr, two.collect()))
    assert corpus_pipeline.tokens(spark, docs, "")._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_many_links_have_a_fingerprint(spark):
    edges = spark.range(400_000).select(F.md5(F.col("id").cast("string")).alias("a"), F.md5(F.concat(F.lit("b"), "id")).alias("b"))
    n, h = graph._print(edges)
    assert n == 400_000 and graph._print(edges.repartition(3)) == (n, h) != graph._print(edges.where("a <> b").limit(399_999))


@pytest.mark.parametrize("n", [64, 512, 750, 1280])
def test_rows_of_blocks_are_kept_in_all_ranges(n):
    found = Counter(blocks.home(part << 24 | k, n) for part in range(n) for k in range(4))
    assert len(found) > 0.9 * n and max(found.values()) < 20
