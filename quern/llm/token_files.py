"""Token-id files: documents compressed one by one under a shared zstandard dictionary.

A shard is one binary body, little-endian throughout: magic ``QTK1``; SHA-256 of the dictionary;
byte width of an id (2 or 4); number of documents; their ids (signed 64-bit, with a null mask);
token counts; offsets of the frames (one more than documents); the frames. A document is read by its
two offsets and one decompression, without its neighbours. Shards are rows of an uncompressed
Parquet table (a store that all Spark readers reach), with first and last document id and counts as
columns, so readers prune to the shards that they need.

Documents stand in ascending ``doc_id`` order, null first; equal ids stand by a hash of their text,
so repeated rows stay, side by side. Null and empty texts hold the end id alone. An empty table gives
no shard. Other columns are not part of the format.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.llm.bpe_codec import byte_letters
from quern.llm.spark import beside, bounded
from quern.llm.texts import SPACE, buffers, chunks, dealt, distinct, listed, spared, word_spans

MAGIC = b"QTK1"
#: Documents that the dictionary is trained on, give or take chance (a hash of doc_id draws them), and its bytes.
DICTIONARY_DOCS = 2_000
DICTIONARY_BYTES = 64 << 10
#: Bytes of one training sample: whole id arrays are cut into such pieces.
SAMPLE_BYTES = 16 << 10
SHARD_BYTES = 2 << 20
#: Bytes of words and ids that a worker remembers, and of an entry beside its word and ids. Unlike other
#: caches this one outlives its task: a word met anew takes 12 to 18 microseconds as a text of its own.
MEMO_BYTES = 240 << 20
ENTRY_BYTES = 170
#: Lines of words whose normal form is themselves and whose letters have one lower case; the pattern that cuts them; the steps of a file that say so.
PLAIN = re.compile("[\n!-~\u00a1-\u012f\u0131-\u017f]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_L, _N = (re.escape("".join(c for c in map(chr, range(0x21, 0x180)) if unicodedata.category(c)[0] == kind)) for kind in "LN")
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\n{_L}{_N}]+|\n")
STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
_LETTERS = np.array([ord(c) for _, c in sorted(byte_letters().items())], "<u4")
_BREAK = chr(_LETTERS[10])


class WordCoder:
    """Encodes whole texts with the tokenizers library, each distinct white-space word once.

    Right for tokenizers that drop white space before they split: no token then spans two words. Others are refused.
    Where the file's steps are the known ones, Latin words are lower-cased and cut here and only their distinct parts go
    to the library's model; the last token of a part has the suffix. All other words go through the whole library.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo: dict[bytes, bytes] = {}
        self.room = MEMO_BYTES
        split = self.library.pre_tokenizer.pre_tokenize_str if self.library.pre_tokenizer else None
        parts = [x for x, _ in split("one \t two\n\nthree")] if split else []
        if any(c.isspace() or c in "\u2581\u0120" for x in parts for c in x) or len(parts) != 3:
            raise QueryError("unsupported_tokenizer", "it keeps white space, so words can't be encoded one by one")
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        marks = [t["content"] for t in spec.get("added_tokens", [])]
        known = (spec.get("normalizer"), spec.get("pre_tokenizer")) == STEPS and not spec.get("post_processor") and all("<|" in m for m in marks)
        self.model = None
        if known and spec["model"].get("end_of_word_suffix") == "</w>":
            self.model = Tokenizer(self.library.model)
            self.last = np.zeros(self.library.get_vocab_size() + 1, bool)
            self.last[[i for token, i in spec["model"]["vocab"].items() if token.endswith("</w>")]] = True

    def _learn(self, unseen: list[bytes]) -> None:
        for at in range(0, len(unseen), 10_000):
            some = unseen[at : at + 10_000]
            found = self._plain(some) or self._whole(some)
            self.memo.update(zip(some, found, strict=True))
            self.room -= sum(map(len, found)) + sum(map(len, some)) + ENTRY_BYTES * len(some)

    def _whole(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, each by the library as a text of its own, but for those that need not be."""
        plain = [w for w in words if PLAIN.fullmatch(w.decode())] if self.model and len(words) > 1 else []
        known = dict(zip(plain, self._plain(plain) or (), strict=False))
        rest = [w for w in words if w not in known]
        found = self.library.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, found, strict=True))
        return [known[w] for w in words]

    def _plain(self, words: list[bytes]) -> list[bytes] | None:
        """The same for Latin words, by their distinct parts; None if any word is not one."""
        text = b"\n".join([*words, b""]).decode()
        if not self.model or not words or not PLAIN.fullmatch(text) or "<|" in text:
            return None
        cut = PARTS.findall(text.lower())
        parts = [p for p in dict.fromkeys(cut) if p != "\n"]
        letters = _LETTERS[np.frombuffer("\n".join(parts).encode(), np.uint8)].tobytes().decode("utf-32-le").split(_BREAK)
        batches = [letters[i : i + 1000] for i in range(0, len(letters), 1000)]
        ids = np.array([i for e in self.model.encode_batch_fast(batches, is_pretokenized=True, add_special_tokens=False) for i in e.ids], "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(parts):
            return None
        raw, ends = ids.tobytes(), ends.tolist()
        known = {p: raw[a:b] for p, a, b in zip(parts, [0, *ends], ends, strict=False)} | {"\n": b"\xff\xff\xff\xff"}
        raw = b"".join(map(known.__getitem__, cut))
        ends = (np.flatnonzero(np.frombuffer(raw, "<u4") == 0xFFFFFFFF) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends, strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> list[bytes]:
        """Packed ids of each text, then ``end``; distinct words are looked up once."""
        if self.room < 0:
            self.memo, self.room = {}, MEMO_BYTES
        data, offsets = buffers(texts)
        starts, ends, first = word_spans(data, offsets)
        found, codes = distinct(data[~SPACE[data]], np.cumsum(np.append(0, ends - starts)), text=False)
        words = listed(found)
        packed = list(map(self.memo.get, words))
        lacking = [i for i, ids in enumerate(packed) if ids is None]
        self._learn([words[i] for i in lacking])
        for i in lacking:
            packed[i] = self.memo[words[i]]
        ids, at = dealt(pa.array(packed, pa.large_binary()), codes, first)
        raw, at = ids.tobytes(), at.tolist()
        return [raw[a:b] + end for a, b in itertools.pairwise(at)]


_coders: dict[str, WordCoder] = {}


def coder(tokenizer: str) -> WordCoder:
    if tokenizer not in _coders:
        _coders[tokenizer] = WordCoder(tokenizer)
    return _coders[tokenizer]


def _encoded(texts: pa.Array, tokenizer: str, end: int) -> list[bytes]:
    return coder(tokenizer).encode_column(texts, end.to_bytes(4, "little"))


def pack(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def unpack(raw: bytes, width: int) -> bytes:
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if width == 2 else raw


def train_dictionary(docs: DataFrame, tokenizer: str, end: int, width: int, column: str = "text") -> bytes:
    """A dictionary from the serialised ids of a bounded sample (whole arrays, in pieces); empty where the sample is too small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column):
            raw = [pack(i, width) for i in _encoded(batch.column(0), tokenizer, end)]
            pieces = [x[at : at + SAMPLE_BYTES] for x in raw for at in range(0, len(x), SAMPLE_BYTES)]
            yield pa.RecordBatch.from_pydict({"raw": pa.array(pieces, pa.binary())})

    n = max(docs.count(), 1)
    drawn = docs.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), F.lit(n)) < DICTIONARY_DOCS).select(column)
    raw = [r["raw"] for r in drawn.mapInArrow(spared(run), "raw binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(bytes(x) for x in raw)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def shard(doc_ids: list, ids: list[bytes], dictionary: bytes, width: int, squeeze: zstandard.ZstdCompressor) -> bytes:
    """The body of one shard."""
    frames = [squeeze.compress(pack(i, width)) for i in ids]
    head = MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<BI", width, len(ids))
    arrays = (
        np.array([d if d is not None else 0 for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], "<u1"),
        np.array([len(i) // 4 for i in ids], "<u4"),
        np.cumsum([0, *map(len, frames)]).astype("<u8"),
    )
    return b"".join([head, *(a.tobytes() for a in arrays), *frames])


class Shard:
    """Random access to the documents of one shard body."""

    def __init__(self, body: bytes, dictionary: bytes):
        if body[:4] != MAGIC or body[4:36] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token shard of this dictionary")
        self.width, n = struct.unpack_from("<BI", body, 36)
        at = 41
        self.doc_ids = np.frombuffer(body, "<i8", n, at)
        self.nulls = np.frombuffer(body, "<u1", n, at + 8 * n)
        self.counts = np.frombuffer(body, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(body, "<u8", n + 1, at + 13 * n)
        self.body, self.base = body, at + 13 * n + 8 * (n + 1)
        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, k: int) -> bytes:
        """The k-th document's ids as little-endian unsigned 32-bit integers."""
        a, b = self.base + int(self.offsets[k]), self.base + int(self.offsets[k + 1])
        return unpack(self.expand.decompress(self.body[a:b], max_output_size=int(self.counts[k]) * self.width), self.width)


def write(docs: DataFrame, path: str, tokenizer: str, end: int, vocabulary: int = 65_536, column: str = "text") -> None:
    """Encode ``docs`` (``doc_id``, text), append ``end`` to each, and write the shards and the dictionary."""
    spark = docs.sparkSession
    bounded(spark)
    width = 2 if max(vocabulary, end + 1) <= 65_536 else 4
    dictionary = train_dictionary(docs, tokenizer, end, width, column)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.option("compression", "none").parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_checksum=False)
        part = TaskContext.get().partitionId()
        keys, ids, size, n = [], [], 0, 0

        def out() -> pa.RecordBatch:
            row = {"shard_id": part << 32 | n, "first_doc": keys[0], "last_doc": keys[-1], "n_docs": len(keys), "n_tokens": sum(map(len, ids)) // 4, "body": shard(keys, ids, dictionary, width, squeeze)}
            return pa.RecordBatch.from_pylist([row], schema=_SHARDS)

        for batch in chunks(batches, column, 1 << 20):
            for key, one in zip(batch.column(0).to_pylist(), _encoded(batch.column(1), tokenizer, end), strict=True):
                keys.append(key)
                ids.append(one)
                size += len(one)
                if size >= 4 * SHARD_BYTES:
                    yield out()
                    keys, ids, size, n = [], [], 0, n + 1
        if keys:
            yield out()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), column).repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64(column))
    ordered.mapInArrow(spared(run), "shard_id long, first_doc long, last_doc long, n_docs long, n_tokens long, body binary").write.option("compression", "none").parquet(f"{path}/shards")


_SHARDS = pa.schema([("shard_id", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("body", pa.binary())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it in all shards), n_tokens, ids (binary)."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    shards = spark.read.schema("shard_id long, first_doc long, last_doc long, n_docs long, n_tokens long, body binary").parquet(f"{path}/shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Shard(body, dictionary)
                before = np.cumsum(s.counts, dtype=np.int64) - s.counts
                for a in range(0, len(s), 500):
                    b = min(a + 500, len(s))
                    yield pa.RecordBatch.from_pydict({
                        "shard_id": pa.array([shard_id] * (b - a), pa.int64()),
                        "doc_id": pa.array(s.doc_ids[a:b], pa.int64(), mask=s.nulls[a:b].astype(bool)),
                        "within": pa.array(before[a:b], pa.int64()),
                        "n_tokens": pa.array(s.counts[a:b].astype(np.int64), pa.int64()),
                        "ids": pa.array([s.ids(k) for k in range(a, b)], pa.binary()),
                    })

    rows = shards.select("shard_id", "body").mapInArrow(spared(run), "shard_id long, doc_id long, within long, n_tokens long, ids binary")
    # Shards are numbered by task and place in it: sums of tasks first (one row a task), then within each task.
    part = F.shiftright("shard_id", 32)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = shards.groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("n"))
    totals = totals.select("part", before("n", Window.orderBy("part")).alias("earlier"))
    offsets = shards.select("shard_id", part.alias("part"), "n_tokens").join(totals, "part")
    offsets = offsets.select("shard_id", (F.col("earlier") + before("n_tokens", Window.partitionBy("part").orderBy("shard_id"))).alias("base"))
    return rows.join(beside(offsets), "shard_id").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")
