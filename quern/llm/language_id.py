"""Language identification as mixture inference: how much of each language does a document hold?

Likelihoods come from byte trigrams of words (letters only, lower case), counted for each language
over all training rows. A document is a mixture: expectation-maximisation estimates the proportions
of languages from its words' likelihoods, each word weighing its letters. Nested sets of languages
(the likeliest one, then two, ... up to all) compete by penalised likelihood; the set with the best
score is kept, and its largest share is the prediction. A document leaves the competition only when
its best set so far beats what a perfect fit of any larger set could score.

Null texts and texts without any letter are ``und`` with score 0. Without training rows every text
is ``und``. Ties go to the language that sorts first. Repeated rows get equal results; a null doc_id
is trained on and not held out. An empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.llm.spark import bounded
from quern.llm.texts import buffers, carried, chunks, extended, spared

BITS = 16
SMOOTH = 0.05
#: Expectation-maximisation ends when no document's weighted log-likelihood gains this much in a step.
GAIN = 0.05
#: Most languages that one model may hold (256 KB each, sent to every executor); more are refused.
MOST_LANGUAGES = 400
#: Nats that one more language of a mixture must gain, per logarithm of the document's words.
PENALTY = 3.0
UNKNOWN = "und"

#: Letters by byte: ASCII letters in lower case and all bytes of longer characters; else 0.
_LETTER = np.zeros(256, np.uint32)
_LETTER[ord("a") : ord("z") + 1] = np.arange(1, 27)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_LETTER[128:] = np.arange(27, 155)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every letter byte its trigram's bucket; where each word starts among these; each word's row."""
    data, offsets = buffers(texts)
    letter = _LETTER[data]
    is_letter = letter > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), np.uint32), np.zeros(len(data), np.uint32)
    before[1:] = letter[:-1]
    before[edge[:-1]] = 0
    after[:-1] = letter[1:]
    after[edge[1:]] = 0
    at = np.flatnonzero(is_letter)
    code = (before[at] * np.uint32(155) + letter[at]) * np.uint32(155) + after[at]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    begins = np.flatnonzero(before[at] == 0)
    row = np.searchsorted(offsets, at[begins], side="right") - 1
    return code, begins, row


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text holds a letter of any script: some byte is an ASCII letter, or a longer character is a letter."""
    data, offsets = buffers(texts)
    plain = (_LETTER[data] > 0) & (data < 128)
    total = np.concatenate([[0], np.cumsum(plain)])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out).tolist():
        piece = bytes(data[offsets[i] : offsets[i + 1]])
        out[i] = any(c.isalpha() for c in set(piece.decode("utf-8", "replace")))
    return out


def learn(docs: DataFrame, column: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (languages, buckets) from all rows with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in chunks(batches, "text"):
            code, begins, row = trigrams(batch.column(0))
            names = batch.column(1).to_pylist()
            known, number = np.unique(np.array(names, dtype=object), return_inverse=True)
            of_word = number[row]
            each = np.repeat(of_word, np.diff(np.append(begins, len(code))))
            got = np.bincount(each * (1 << BITS) + code, minlength=len(known) << BITS).reshape(len(known), -1)
            for name, c in zip(known.tolist(), got, strict=True):
                table[name] = table.get(name, 0) + c
        rows = [(name, c.astype("<i8").tobytes()) for name, c in table.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, "<i8") for c in group.column("counts").to_pylist())
        return pa.table({"lang": group.column("lang").slice(0, 1), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    bounded(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(column).isNotNull()).select(F.col(column).alias("text"), F.col(lang).alias("lang"))
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise QueryError("too_many_languages", f"at most {MOST_LANGUAGES}")
    # A fixed-size table for each language and task, added up in two steps.
    each = rows.mapInArrow(spared(count), "lang string, counts binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    each = each.groupBy("lang", "part").applyInArrow(lambda g: add(g.select(["lang", "counts"])), "lang string, counts binary")
    found = sorted(each.groupBy("lang").applyInArrow(add, "lang string, counts binary").collect(), key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(r["counts"], "<i8") for r in found], float).reshape(len(found), 1 << BITS)
    p = counts + SMOOTH
    return [r["lang"] for r in found], np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32)


def mixtures(code: np.ndarray, begins: np.ndarray, row: np.ndarray, n_rows: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows, languages) of the chosen sets, zero outside them, and how many languages each set has."""
    n_lang = len(table)
    share, size = np.zeros((n_rows, n_lang)), np.zeros(n_rows, np.int64)
    if not len(begins):
        return share, size
    fit = np.stack([np.add.reduceat(t[code], begins) for t in table], axis=1).astype(float)
    weight = np.diff(np.append(begins, len(code))).astype(float)
    top = fit.max(axis=1)
    like = np.exp(fit - top[:, None])
    at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    docs = row[at]
    number = np.cumsum(np.append(True, row[1:] != row[:-1])) - 1
    letters, words = np.add.reduceat(weight, at), np.diff(np.append(at, len(row)))
    alone = np.add.reduceat(fit, at)

    def em(allowed: np.ndarray, like: np.ndarray, weight: np.ndarray, number: np.ndarray, at: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi, before = allowed / allowed.sum(axis=1, keepdims=True), -np.inf
        while True:  # every step gains, so this ends
            r = pi[number] * like
            mass = np.maximum(r.sum(axis=1), 1e-300)
            log = np.log(mass)
            now = np.add.reduceat(weight * log, at)
            if (now - before).max() < GAIN:
                return pi, np.add.reduceat(log, at)
            before = now
            r *= (weight / mass)[:, None]
            pi = np.add.reduceat(r, at) / letters[:, None]

    order = np.argsort(-alone, axis=1, kind="stable")
    best = np.zeros((len(docs), n_lang))
    best[np.arange(len(docs)), order[:, 0]] = 1
    base = np.add.reduceat(top, at)
    value, count = alone.max(axis=1) - base, np.ones(len(docs), np.int64)
    cost = PENALTY * np.log(words + 1)
    # Only documents whose words' own best languages could pay for a second one need the mixture.
    open_ = np.flatnonzero(-value > cost) if n_lang > 1 else np.zeros(0, np.int64)
    if len(open_):
        chosen = np.isin(number, open_)
        like, weight, number = like[chosen], weight[chosen], np.searchsorted(open_, number[chosen])
        at = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        full, _ = em(np.ones((len(open_), n_lang)), like, weight, number, at, letters[open_])
        order = np.argsort(-full, axis=1, kind="stable")
        for k in range(2, n_lang + 1):
            # No set fits better than 0, so k languages score -(k - 1) * cost at most.
            still = -(k - 1) * cost[open_] > value[open_] - (count[open_] - 1) * cost[open_]
            if not still.any():
                break
            if not still.all():
                chosen = still[number]
                like, weight, number = like[chosen], weight[chosen], (np.cumsum(still) - 1)[number[chosen]]
                at = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
                open_, order = open_[still], order[still]
            allowed = np.zeros((len(open_), n_lang))
            np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
            pi, got = em(allowed, like, weight, number, at, letters[open_])
            better = got - (k - 1) * cost[open_] > value[open_] - (count[open_] - 1) * cost[open_]
            best[open_[better]], value[open_[better]], count[open_[better]] = pi[better], got[better], k
    share[docs], size[docs] = best, count
    return share, size


ADDED = "lang_pred string, score double, langs array<string>, shares array<double>"


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], column: str = "text") -> DataFrame:
    """Every row of ``docs`` with lang_pred, score (its share), langs (the chosen set) and shares added."""
    names, table = model
    sent = docs.sparkSession.sparkContext.broadcast(table)  # languages x 2 ** BITS, see MOST_LANGUAGES
    rows, schema, at, kept = carried(docs, column, ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at, 1 << 20):
            texts = batch.column(at)
            n = batch.num_rows
            share, _ = mixtures(*trigrams(texts), n, sent.value) if names else (np.zeros((n, 0)), None)
            known = has_letter(texts) & (share.sum(axis=1) > 0)
            top = share.argmax(axis=1) if names else np.zeros(n, np.int64)
            pred = [names[t] if k else UNKNOWN for t, k in zip(top.tolist(), known.tolist(), strict=True)]
            value = np.where(known, share.max(axis=1, initial=0), 0.0)
            sets = [np.flatnonzero(s > 0).tolist() if k else [] for s, k in zip(share, known, strict=True)]
            langs = pa.array([[names[i] for i in s] for s in sets], pa.list_(pa.string()))
            shares = pa.array([[float(x[i]) for i in s] for x, s in zip(share, sets, strict=True)], pa.list_(pa.float64()))
            yield extended(batch, kept, ADDED, [pa.array(pred, pa.string()), pa.array(np.clip(value, 0, 1)), langs, shares])

    return rows.mapInArrow(spared(run), schema)
