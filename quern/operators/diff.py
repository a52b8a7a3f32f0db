"""Differences of texts: lossless tokens, shortest edit scripts, block-level differences with moves."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Edits after which a stretch is replaced as a whole.
MOST_EDITS = 8192
#: Pairs of tokens up to which a stretch is solved by rows of bits, an eighth of a byte each; longer ones are halved first.
BIT_PAIRS = 1 << 29
OPS = "array<struct<type:string,text:string>>"


def lines(text: Column) -> Column:
    """Lines with their terminators; joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(r"([^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+\z)"), F.lit(1))


def words(text: Column) -> Column:
    """Runs of white space and of anything else; joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(r"(\s+|[^\s]+)"), F.lit(1))


_CLUSTERS = regex.compile(
    r"\s+|[\U0001F1E6-\U0001F1FF]{2}"
    r"|[\p{Extended_Pictographic}](?:\uFE0F|[\U0001F3FB-\U0001F3FF])*(?:\u200D\p{Extended_Pictographic}(?:\uFE0F|[\U0001F3FB-\U0001F3FF])*)*"
    r"|[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]|[\p{L}\p{M}\p{N}_]+(?:['’][\p{L}\p{M}]+)*|.",
    regex.S,
)


@F.pandas_udf(ArrayType(StringType()))
def clusters(text: pd.Series) -> pd.Series:
    """Tokens as readers see them: white space, flags, emoji, each CJK character, words, anything else; joined they give the text back."""
    cjk = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]|[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+")
    return text.map(lambda t: [c for x in _CLUSTERS.findall(t or "") for c in (cjk.findall(x) if x.isalnum() else [x])])


_NONE = -(1 << 40)


def _frontier(x: np.ndarray, y: np.ndarray, old: np.ndarray, zero: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All furthest points of ``d`` edits: their diagonals, where they begin to run along equal tokens, and where they end."""
    n, m = len(x), len(y)
    low, high = max(-d, -m + (d + m) % 2), min(d, n - (d + n) % 2)
    k = np.arange(low, high + 1, 2)
    up, left = old[zero + k + 1], old[zero + k - 1] + 1
    begin = np.maximum(up, left) if d else np.zeros(1, np.int64)
    begin = np.where((begin > n) & (up >= 0), up, begin)
    begin = np.where((begin < 0) | (begin > n) | (begin - k > m) | (begin - k < 0), _NONE, begin)
    end = begin.copy()
    going = np.flatnonzero((end >= 0) & (end < n) & (end - k < m))
    while len(going):
        same = x[end[going]] == y[end[going] - k[going]]
        going = going[same]
        end[going] += 1
        going = going[(end[going] < n) & (end[going] - k[going] < m)]
    return k, begin, end


def _middle(x: np.ndarray, y: np.ndarray, most: int) -> tuple[int, int, int, int] | None:
    """A run of equal tokens (maybe none) half way of a shortest script: its start and end in both; None past ``most`` edits.

    Furthest points are followed from both ends until two of them meet on a diagonal; memory is linear in the edits.
    """
    n, m = len(x), len(y)
    delta, rx, ry = n - m, x[::-1], y[::-1]
    reach = min((n + m + 1) // 2, most // 2 + 1)
    zero = reach + abs(delta) + 2
    ahead, back = np.full(2 * zero + 1, _NONE), np.full(2 * zero + 1, _NONE)
    for d in range(reach + 1):
        for own, other, backward in ((ahead, back, False), (back, ahead, True)):
            a, b = (rx, ry) if backward else (x, y)
            k, begin, end = _frontier(a, b, own, zero, d)
            if (delta % 2 == 1) != backward and (2 * d - (not backward)) <= most:
                facing = delta - k
                inside = np.abs(facing) <= zero
                far = np.where(inside, other[zero + np.where(inside, facing, 0)], _NONE)
                met = np.flatnonzero((end >= 0) & (far >= 0) & (end + far >= n))
                if len(met):
                    i = met[0]
                    p, q, c = int(begin[i]), int(end[i]), int(k[i])
                    return (n - q, m - (q - c), n - p, m - (p - c)) if backward else (p, p - c, q, q - c)
            own[zero + k] = end
    return None


def _common(x: list[int], y: list[int]) -> tuple[list[int], list[int]]:
    """Places in both of a longest common subsequence, from its table by rows of bits: a token costs a few operations on one long number.

    In the row of ``y`` up to j, bit i is clear where the i-th token of ``x`` lengthens what can be kept of those before it.
    """
    where: dict[int, int] = {}
    for i, t in enumerate(x):
        where[t] = where.get(t, 0) | 1 << i
    whole = (1 << len(x)) - 1
    rows = [whole]
    for t in y:
        row = rows[-1]
        met = row & where.get(t, 0)
        rows.append((row + met | row - met) & whole)
    i, j, left, right = len(x), len(y), [], []
    while j:
        i = (~rows[j] & (1 << i) - 1).bit_length()  # tokens of x that lengthen nothing are passed over
        if not i:
            break
        j -= 1
        if rows[j] >> i - 1 & 1:
            i -= 1
            left.append(i)
            right.append(j)
    return left[::-1], right[::-1]


def _kept(x: np.ndarray, y: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """Runs that a shortest script keeps; none past ``most`` edits. Tokens that the other side lacks take no part in the table."""
    i, j = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    left, right = _common(x[i].tolist(), y[j].tolist())
    if not left or len(x) + len(y) - 2 * len(left) > most:
        return []
    a, b = i[left], j[right]
    first = np.flatnonzero(np.append(True, (np.diff(a) != 1) | (np.diff(b) != 1)))
    return list(zip(a[first].tolist(), b[first].tolist(), np.diff(np.append(first, len(a))).tolist(), strict=True))


def matches(x: np.ndarray, y: np.ndarray, most: int = MOST_EDITS) -> list[tuple[int, int, int]]:
    """Runs (start in x, start in y, length) that a shortest script keeps, in order; a stretch past ``most`` edits keeps none."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        p, q = x[a0:a1], y[b0:b1]
        w = min(len(p), len(q))
        differ = np.flatnonzero(p[:w] != q[:w])
        head = int(differ[0]) if len(differ) else w
        differ = np.flatnonzero(p[head:][::-1][: w - head] != q[head:][::-1][: w - head])
        tail = int(differ[0]) if len(differ) else w - head
        out += [(a0, b0, head)] * (head > 0) + [(a1 - tail, b1 - tail, tail)] * (tail > 0)
        a0, a1, b0, b1 = a0 + head, a1 - tail, b0 + head, b1 - tail
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= BIT_PAIRS:
            out += [(a0 + i, b0 + j, n) for i, j, n in _kept(x[a0:a1], y[b0:b1], most)]
        elif found := _middle(x[a0:a1], y[b0:b1], most):
            i, j, u, v = found
            out += [(a0 + i, b0 + j, u - i)] * (u > i)
            todo += [(a0, a0 + i, b0, b0 + j), (a0 + u, a1, b0 + v, b1)]
    return sorted(out)


def shortest(x: list[str], y: list[str], most: int = MOST_EDITS) -> list[tuple[str, list[str]]]:
    """A shortest edit script (Myers, in linear space): runs to keep, delete (first) and insert; a stretch past ``most`` edits is replaced."""
    codes: dict[str, int] = {}
    number = lambda ts: np.array([codes.setdefault(t, len(codes)) for t in ts], np.int64)
    out: list[tuple[str, list[str]]] = []
    i = j = 0
    for a, b, n in [*matches(number(x), number(y), most), (len(x), len(y), 0)]:
        for kind, tokens in (("delete", x[i:a]), ("insert", y[j:b]), ("keep", x[a : a + n])):
            if tokens and out and out[-1][0] == kind:
                out[-1][1].extend(tokens)
            elif tokens:
                out.append((kind, list(tokens)))
        i, j = a + n, b + n
    return out


def script(old: Column, new: Column) -> Column:
    """Edit script between two token arrays: keep, delete (first), insert; neighbours of a kind are merged."""

    @F.pandas_udf(OPS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        sides = ((list(x if x is not None else []), list(y if y is not None else [])) for x, y in zip(a, b, strict=True))
        return pd.Series([[{"type": k, "text": "".join(ts)} for k, ts in shortest(x, y)] for x, y in sides])

    return run(old, new)


def token_script(old: Column, new: Column) -> Column:
    """The same with the tokens of each run."""

    @F.pandas_udf("array<struct<type:string,tokens:array<string>>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        sides = ((list(x if x is not None else []), list(y if y is not None else [])) for x, y in zip(a, b, strict=True))
        return pd.Series([[{"type": k, "tokens": ts} for k, ts in shortest(x, y)] for x, y in sides])

    return run(old, new)


def structured(old: DataFrame, new: DataFrame, doc: str, key: str, place: str, text: str) -> DataFrame:
    """Blocks of two versions of each document by key: inserted, deleted, moved (off the longest run in order), changed or unchanged."""
    rows = blocks(old, new, [doc, key], place, text)

    def spine(group: pd.DataFrame) -> pd.DataFrame:
        both = group[group["old_place"].notna() & group["new_place"].notna()].sort_values("new_place")
        tails: list[float] = []
        ends: list[int] = []
        before: dict[int, int | None] = {}
        for i, at in both["old_place"].items():
            k = bisect_left(tails, at)
            before[i] = ends[k - 1] if k else None
            tails[k:], ends[k:] = [at, *tails[k + 1 :]], [i, *ends[k + 1 :]]
        kept, i = set(), ends[-1] if ends else None
        while i is not None:
            kept.add(i)
            i = before[i]
        moved = both.index.difference(list(kept))
        group.loc[moved, "status"] = "moved"
        return group

    return rows.groupBy(doc).applyInPandas(spine, rows.schema)


def side(ops: Column, dropped: str) -> Column:
    """One side of a script: all but the ``dropped`` kind, joined."""
    return F.array_join(F.transform(F.filter(ops, lambda o: o["type"] != dropped), lambda o: o["text"]), "")


def html(ops: Column) -> Column:
    """The script as ``<ins>`` and ``<del>`` with text escaped."""
    escaped = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = lambda o, tag: F.concat(F.lit(f"<{tag}>"), escaped(o["text"]), F.lit(f"</{tag}>"))
    return F.array_join(F.transform(ops, lambda o: F.when(o["type"] == "insert", mark(o, "ins")).when(o["type"] == "delete", mark(o, "del")).otherwise(escaped(o["text"]))), "")


def blocks(old: DataFrame, new: DataFrame, key: list[str], place: str, text: str) -> DataFrame:
    """Block-level difference of two versions by key: status inserted, deleted, changed or unchanged."""
    a = old.select(*key, F.col(place).alias("old_place"), F.col(text).alias("_a"))
    b = new.select(*key, F.col(place).alias("new_place"), F.col(text).alias("_b"))
    status = F.when(F.col("old_place").isNull(), "inserted").when(F.col("new_place").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").otherwise("unchanged")
    return a.join(b, key, "full").select(*key, "old_place", "new_place", status.alias("status"))
