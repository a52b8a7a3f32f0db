"""Alignment, fingerprints and divergence against brute force, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quern.llm import alignment, divergence, fingerprints, queries
from quern.llm.bpe_codec import byte_letters

SCHEMA = "doc_id long, text string, lang string, source string, groups string, fingerprint string, part int, n string"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def make(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, None, None, None, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    out = [
        (1, "The cat sat on the mat. The cat sat.", "en", "a"), (2, "the CAT sat on 12,5 mats\n\n  and\tdon't", "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, "cat cat dog dog the the", "en", None),
        (6, "<|endoftext|> <s> <0x41> </s> in text", "en", "c"), (7, "has ▁ inside", "en", "a"), (8, "été ß 日本  x 😀 ́e \x00 z", "fr", "b"), (9, "x" * 3000, "en", "a"), (10, "the cat " * 9000, "en", "b"),
        (11, "dup row", "de", "a"), (11, "dup row", "de", "a"), (11, "another text", "de", "b"), (None, "no id the cat", "en", "c"), (12, "a", "en", "c"), (13, "  lead and trail  ", "en", "c"), (14, "ÀÉ été ÀÉ cat", "fr", "a"), (15, "ÀÉ été", "fr", "a"), (16, "ÀÉ", "fr", "c"),
    ]
    return out


def spans(rows):
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    back = {c: x for x, c in byte_letters().items()}

    def piece(i):
        p = b.id_to_piece(i)
        m = re.fullmatch(r"<0x(..)>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    for r in rows:
        text = r[1] or ""
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        u, v = [bytes(back[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        yield (x, y, u, v) if text and b"".join(u) == b"".join(v) == (" " + text).encode() else ([], [], [], [])


def test_alignment_of_two_tokenizers(spark, rows):
    found, counts = [], Counter()
    for x, y, u, v in spans(rows):
        ends_x, ends_y = np.cumsum([len(t) for t in u]).tolist(), np.cumsum([len(t) for t in v]).tolist()
        groups, links, p, q = [], [], 0, 0
        for end in sorted(set(ends_x) & set(ends_y)):
            i, j = ends_x.index(end) + 1, ends_y.index(end) + 1
            groups.append(",".join(map(str, x[p:i])) + "|" + ",".join(map(str, y[q:j])))
            links.append((x[i - 1], y[j - 1]))
            p, q = i, j
        found.append((len(x), len(y), groups, links))
        counts.update(links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter()
    for r, (n_a, n_b, groups, links) in zip(rows, found, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        want[r[0], n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest] += 1
    got = alignment.summary(make(spark, rows), BYTES, PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want and sum(k[1] == 0 for k in want.elements()) == 3
    table = alignment.pair_counts(alignment.align(make(spark, rows), BYTES, PIECES)).collect()
    assert {(r["a"], r["b"]): r["links"] for r in table} == counts and all(r["best_b"] == most[r["b"]] for r in table)
    assert not alignment.summary(make(spark, []), BYTES, PIECES).collect()


def test_merged_ends_of_tokens_without_bytes():
    cut_a, cut_b, i, j = alignment.merged(np.array([1, 3, 3, 5]), np.array([2, 3, 5, 5]))
    assert cut_a.tolist() == [3, 4] and cut_b.tolist() == [2, 4]
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(1, 1), (2, 1), (3, 2), (3, 3)]


def one_digest(text):
    """Counts of one text, window by window."""
    data, n = text.encode() + b"\0\0\0\0", len(text.encode())
    c = np.zeros(fingerprints.BUCKETS, int)
    for at in range(n):
        for k, (i, j) in enumerate(fingerprints.OTHERS):
            c[fingerprints._TABLES[0, k, data[at]] ^ fingerprints._TABLES[1, k, data[at + i]] ^ fingerprints._TABLES[2, k, data[at + j]]] += 1
    marks = np.sort(c)[[63, 127, 191]]
    return [round(8 * np.log2(n + 1)), *(int(sum(x > m for m in marks)) for x in c)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(fingerprints, "PIECE_BYTES", 64)
    monkeypatch.setattr(fingerprints, "ROWS", 3)


def test_digests_and_likeness(small):
    texts = ["", "a", "ab", "some text here", "some text hers", "é" * 50, "word " * 80]
    got = fingerprints.digests(texts)
    assert got.tolist() == [one_digest(t) for t in texts]
    assert (fingerprints.unpacked(fingerprints.packed(got)) == got).all()
    near = lambda i, j: fingerprints.alike(got[[i]], got[[j]])[0]
    assert all(near(i, i) == 1 for i in range(7)) and near(0, 3) == 0 and near(1, 6) < 0.2 < near(3, 4) < 1 and near(3, 4) == near(4, 3)


def test_documents_against_the_next(spark, rows):
    got = fingerprints.with_next(make(spark, rows).repartition(3)).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    assert len(got) == len(rows) and len(by_id[11]) == 3
    ordered = sorted((r for r in rows if r[0] != 11), key=lambda r: (r[0] is not None, r[0] or 0))
    prints = {}
    for r in got:
        prints.setdefault((r["n_chars"], r["doc_id"]), r["fingerprint"])
    for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        if b[0] == 12:  # behind the rows of one id
            continue
        text, after = a[1] or "", b[1] or ""
        row = by_id[a[0]][0]
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        own, new, other = fingerprints.digests([text, changed, after])
        assert [row["fingerprint"], row["edited_fingerprint"]] == fingerprints.packed(np.array([own, new]))
        assert row["near_edited"] == fingerprints.alike(own[None], new[None])[0] and row["near_next"] == fingerprints.alike(own[None], other[None])[0]
    twins = [r for r in by_id[11] if r["n_chars"] == len("dup row")]
    assert len({r["fingerprint"] for r in twins}) == 1 and max(r["near_next"] for r in twins) == 1
    assert not fingerprints.with_next(make(spark, [])).collect()
    (alone,) = fingerprints.with_next(make(spark, [(7, "abcd", None, None)])).collect()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1


def test_fingerprint_columns(spark, rows):
    df = fingerprints.fingerprint(make(spark, rows))
    assert df.columns.count("fingerprint") == 1 and {r["n"] for r in df.collect()} == {"x"}
    pairs = fingerprints.compared(df.selectExpr("fingerprint as a", "if(doc_id = 3, null, fingerprint) as b"), "a", "b").collect()
    assert sum(r["likeness"] is None for r in pairs) == 1 and all(r["likeness"] in (1, None) for r in pairs)


def brute_audit(rows, least, most):
    docs = [([t.lower() for t in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").encode())], r[2] or "", r[3] or "") for r in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        df = Counter(t for d in own for t in set(d[0]))
        kept = sorted(t for t in df if df[t] >= least)
        total = {s: Counter(t for d in own if d[2] == s for t in d[0] if df[t] >= least) for s in {d[2] for d in own}}
        whole = sum(total.values(), Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) * (p - q) // q
        for s in total:
            pairs = [(-sum(f(share(total[s], t), share(total[u], t)) for t in kept), u.encode()) for u in total if u != s]
            terms = [(-f(share(total[s], t), share(whole, t)), t) for t in kept if total[s][t] and share(total[s], t) > share(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return Counter(out)


def corpus():
    rng = np.random.RandomState(3)
    out = []
    for i in range(260):
        lang, source = ["en", "fr", None][min(i % 7, 2)], [f"s{rng.randint(9)}", "hot", None][min(rng.randint(3), 2)]
        words = [f"{'abcdefgh'[k % 8] * (1 + k % 3)}{'éßzÅ'[k % 4]}{'qrst'[k // 8 % 4]}" for k in np.minimum(rng.zipf(1.3, 25), 90)]
        words += ["long" * 40 + "xyzuvw"[rng.randint(6)] + "é" * rng.randint(3), "Ab1Cd'ef"]
        out.append((i, " ".join(words), lang, source))
    return [*out, (900, None, "void", "x"), (901, "", "void", None), (902, "once", "void", "y")]


@pytest.mark.parametrize("few", [4096, 1])
def test_divergence_of_sources(spark, rows, few, monkeypatch):
    monkeypatch.setattr(divergence, "FEW", few)
    monkeypatch.setattr(divergence, "PAIRS", 64)
    monkeypatch.setattr(divergence, "BLOCK", 3 if few == 1 else 256)  # lists in several blocks
    docs = corpus() + list(rows)
    got = divergence.audit(make(spark, docs).repartition(3), most=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_audit(docs, divergence.LEAST_DOCS, 7)
    assert not divergence.audit(make(spark, [])).collect()


def test_counts_in_small_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "COUNT_BYTES", 2000)  # tasks send what they have many times
    assert Counter(map(tuple, divergence.audit(make(spark, corpus()), most=50).collect())) == brute_audit(corpus(), 3, 50)


def test_radix_top_of_ties_and_long_heads(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FEW", 4)
    rng = np.random.RandomState(1)
    data = [(g, f"{'p' * (300 * (g == 'b'))}{i:04d}é"[: 400 - i % 2], int(rng.choice([0, 5, 5, 5, 1 << 40, (1 << 59) + i]))) for g, n in (("a", 400), ("b", 300), ("c", 3)) for i in range(n)]
    got = divergence.radix_top(spark.createDataFrame(data, "g string, item string, value long"), ["g"], "value", "item", 6 + 100)
    want = []
    for g in "abc":
        ranked = sorted((x for x in data if x[0] == g), key=lambda x: (-x[2], x[1].encode()))
        want += [(*x, k + 1) for k, x in enumerate(ranked[:106])]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_divergence_query_against_its_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = db.execute(queries.ORACLES["op13_divergence"])
    names = [d[0] for d in cur.description]
    assert Counter(map(tuple, queries.op13_divergence(spark, sf).select(*names).collect())) == Counter(cur.fetchall())
