"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids meet how often.

Tokenizer A is a byte-level BPE, B one of pieces with byte fallback. Both write the same bytes (a space and the text), so
their tokens are spans of one byte string. In batches, the two lists of cumulative token ends are merged: ends in both
cut the tokens into groups, and the tokens that end there are linked. Spark counts the links of each pair of ids, finds
the largest count of each id on either side, and joins these back to the documents.

``align`` keeps every input column (columns with the names of added ones are replaced). Null and empty texts, and those
whose tokens do not write exactly the space and the text (a U+2581 in the text, say), have no tokens: empty lists and
zeros. Special tokens' strings are plain text. Rows are independent: repeated ones give equal results and count again. An
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.llm.bpe_codec import byte_letters
from quern.llm.spark import beside, bounded, written
from quern.llm.texts import chunks, spared

#: Fixed value: the byte-level pre-tokenizer's pattern.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Bytes of text that are tokenized at once.
TEXT_BYTES = 1 << 20
_ADDED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
_known: dict[tuple[str, str], "Both"] = {}


class Both:
    """The two tokenizers, with the bytes of every token."""

    def __init__(self, a: str, b: str):
        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        back, special = {c: x for x, c in byte_letters().items()}, {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        merges = [ranks[bytes(back[c] for c in (m.replace(" ", "") if isinstance(m, str) else "".join(m)))] for m in spec["model"]["merges"]]
        if merges != sorted(merges):
            raise QueryError("unsupported_tokenizer", "ids must rise in the order of the merges")
        self.a = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes_a[v] = k
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) and self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = ([str(i) for i in range(len(t))] for t in (self.bytes_a, self.bytes_b))

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and of B for every text; none where their bytes are not the space and the text."""
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            if text:
                whole = " " + text
                a, raw = self.a.encode_ordinary(whole), whole.encode()
                if b"".join([self.bytes_b[i] for i in b]) == raw and b"".join([self.bytes_a[i] for i in a]) == raw:
                    yield a, b
                    continue
            yield [], []


def both(a: str, b: str) -> Both:
    """A worker loads each pair of vocabularies once."""
    if (a, b) not in _known:
        _known[a, b] = Both(a, b)
    return _known[a, b]


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of A and of B up to each common end, and the tokens (of A, of B) of each link.

    Ends rise; tokens without bytes share an end with the token before them, and each of these is linked.
    """
    shared = np.intersect1d(ends_a, ends_b)
    cut_a, cut_b = (np.searchsorted(e, shared, side="right") for e in (ends_a, ends_b))
    n_a, n_b = cut_a - np.searchsorted(ends_a, shared), cut_b - np.searchsorted(ends_b, shared)
    if len(shared) == 0 or (n_a.max() == 1 and n_b.max() == 1):
        return cut_a, cut_b, cut_a - 1, cut_b - 1
    i = [a - 1 - x for a, x_n, y_n in zip(cut_a, n_a, n_b, strict=True) for x in range(x_n) for _ in range(y_n)]
    j = [b - 1 - y for b, x_n, y_n in zip(cut_b, n_a, n_b, strict=True) for _ in range(x_n) for y in range(y_n)]
    return cut_a, cut_b, np.array(i, np.int64), np.array(j, np.int64)


def aligned(work: Both, a: list[int], b: list[int]) -> tuple:
    """n_a, n_b, n_groups, n_links, groups, the distinct linked pairs of ids (A's in the upper half), and how often each is linked."""
    if not a:
        return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    cut_a, cut_b, i, j = merged(np.cumsum(work.size_a[x]), np.cumsum(work.size_b[y]))
    left, right = [work.text_a[k] for k in a], [work.text_b[k] for k in b]
    parts, p, q = [], 0, 0
    for u, v in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
        parts.append(f"{left[p]}|{right[q]}" if u == p + 1 and v == q + 1 else f"{','.join(left[p:u])}|{','.join(right[q:v])}")
        p, q = u, v
    pairs, times = np.unique(x[i] << 32 | y[j], return_counts=True)
    return len(a), len(b), len(cut_a), len(i), ";".join(parts), pairs, times


def align(docs: DataFrame, a: str, b: str, column: str = "text") -> DataFrame:
    """Every row with its tokens' groups as text (``a1,a2|b1;a3|b2,b3``), and its linked pairs of ids and their times.

    Added: n_a, n_b, n_groups, n_links, groups, pairs (A's id << 32 | B's), times. ``a``: file of a byte-level BPE; ``b``: a model of pieces.
    """
    names = [c.split()[0] for c in _ADDED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = both(a, b)
        for batch in chunks(batches, column, TEXT_BYTES):
            rows = [aligned(work, *t) for t in work.tokens(batch.column(batch.schema.get_field_index(column)).to_pylist())]
            n_a, n_b, groups, links, text, pairs, times = zip(*rows, strict=True)
            at = pa.array(np.append(0, np.cumsum([len(p) for p in pairs])), pa.int32())
            kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(c))) for c in (pairs, times)]
            yield pa.RecordBatch.from_pydict(kept | dict(zip(names, [*(pa.array(c, pa.int64()) for c in (n_a, n_b, groups, links)), pa.array(text, pa.string()), *lists], strict=True)))

    bounded(docs.sparkSession)
    base = docs.drop(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), _ADDED])
    return base.mapInArrow(spared(run), schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, a, b, links (corpus-wide), best_a and best_b: the largest count of a pair with the same id of A, of B."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    found = written(each.groupBy("pair").agg(F.sum("times").alias("links")).select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.expr("cast(pair & 4294967295L as int)").alias("b"), "links"))
    for side in ("a", "b"):
        found = found.join(found.groupBy(side).agg(F.max("links").alias(f"best_{side}")), side)
    return written(found.select("pair", "a", "b", "links", "best_a", "best_b"))


def scored(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """key, n_best (links whose pair is the commonest of its B id, ties included) and count_sum (over links) of every row with links."""
    each = rows.select(key, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(key, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    known = beside(counts.select("pair", "links", (F.col("links") == F.col("best_b")).alias("best")))
    met = each.join(known, "pair")
    return met.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("times")).alias("count_sum"))


def summary(docs: DataFrame, a: str, b: str, column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    rows = align(docs.select("doc_id", F.col(column).alias("text")), a, b).withColumn("row", F.monotonically_increasing_id())
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    rows = written(rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))
    found = scored(rows, pair_counts(rows), "row")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs", "times").join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
