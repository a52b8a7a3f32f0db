"""Audit of how sources of a language diverge in their words: exact integer shares, pairs of sources, leading terms.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A language keeps the terms that stand in
``LEAST_DOCS`` of its documents (rows; a repeated row counts again). Every (lang, source) group, and every language, gives
each kept term the share ``1 + floor(SCALE * (count + 1) / (N + V))``; a share p diverges from q by floor((p - q)^2 / q).

* ``pairs``: each source against each other one of its language, summed over all kept terms. Most counts are zero, so a
  sum starts at the baseline (both counts zero), is corrected for each group's own counts by its histogram of shares,
  and for the terms that both hold by partial sums that tasks form before anything is shuffled.
* ``leading``: each group's terms above the language's share, the ``most`` of largest divergence. ``radix_top`` finds
  each group's last one by histograms over the bits of the values, then over the UTF-8 bytes of equal ones.

Null text, lang and source count as ''. Groups without terms take part in ``pairs``; without kept terms the values are 0.
Ties go by the UTF-8 bytes of the item. An empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.spark import beside, bounded, written
from quern.llm.texts import chunks, ragged, spared

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCS = 3
SCALE = 1_000_000_000
LEADING = 200
#: Bytes of terms and counts that a task holds before it sends what it has, and bytes of an entry beside its term.
COUNT_BYTES, ENTRY_BYTES = 64 << 20, 320
#: Sources that one list of a term's counts holds about, and pairs of them that are worked on at once.
BLOCK, PAIRS = 256, 1 << 20
#: Bits of a value, and bytes of a term, that one histogram tells apart; a bin of so few rows is ranked as it is.
BITS, BYTES, FEW = 12, 2, 4096


def counted(docs: DataFrame, column: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it): parts, added up per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        room = COUNT_BYTES

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 1 << 16):
                    part = terms[at : at + (1 << 16)]
                    names = [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in chunks(batches, "text"):
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = TERM.findall(text.encode().lower())
                if words:
                    n, d = held[lang, source]
                    once = set(words)
                    new = once - n.keys()
                    n.update(words)
                    d.update(once)
                    room -= sum(map(len, new)) + ENTRY_BYTES * len(new)
                    if room < 0:
                        yield from out()
                        room = COUNT_BYTES
        yield from out()

    bounded(docs.sparkSession)
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((column, "text"), ("lang", "lang"), ("source", "source"))))
    return texts.mapInArrow(spared(count), "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + 1), wide(total + kept)) + 1


def diverged(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exact: shares are below 2^30, or so."""
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """Counts, totals and shares of all (lang, source) groups of some documents."""

    def __init__(self, docs: DataFrame, column: str = "text", least: int = LEAST_DOCS):
        names = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
        groups = written(docs.select(*names).distinct())
        # Dealt by (lang, term), so that the sums by source and those by term need no shuffle of their own.
        dealt = counted(docs, column).repartition("lang", "term")
        each = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        w = Window.partitionBy("lang", "term")
        each = each.withColumns({"total": F.sum("n").over(w), "docs": F.sum("docs").over(w), "first": F.min("source").over(w) == F.col("source")})
        kept = written(each.where(F.col("docs") >= least).drop("docs"))
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        langs = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
        stats = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        zero = F.lit(0).cast("long")
        stats = stats.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n", "kept", "lang_n")))
        #: lang, source, kept (V), group_n (N), lang_n, base: the share of a term that the group lacks (null without kept terms).
        self.groups = written(stats.select("lang", "source", "kept", F.col("n").alias("group_n"), "lang_n", F.when(F.col("kept") > 0, share(zero, F.col("n"), F.col("kept"))).alias("base")))
        #: lang, source, term, n, p (the group's share), q (the language's), base: one row for each term that a group holds.
        rows = kept.join(beside(self.groups), ["lang", "source"])
        self.shares = written(rows.select("lang", "source", "term", "n", share(F.col("n"), F.col("group_n"), F.col("kept")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("kept")).alias("q"), "base"))

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value."""
        each = self.groups.select("lang", "source", "kept", "base")
        other = each.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"))
        sums = self._one_sided(each, other).unionByName(self._shared())
        sums = sums.groupBy("lang", "source", "item").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
        pairs = each.join(other, "lang").where(F.col("source") != F.col("item"))  # the rows of the result
        value = F.coalesce(F.col("kept") * diverged(F.col("base"), F.col("other_base")), F.lit(0)) + F.coalesce("part", F.lit(0))
        return pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", value.cast("long").alias("value"))

    def _one_sided(self, each: DataFrame, other: DataFrame) -> DataFrame:
        """What a group's own counts change against the baseline, and what the other's change: by histograms of shares."""
        bars = written(self.shares.groupBy("lang", "source", "base", "p").agg(F.count(F.lit(1)).alias("terms")))
        both = diverged(F.col("base"), F.col("other_base"))
        mine = bars.join(beside(written(other)), "lang").where(F.col("source") != F.col("item"))
        mine = mine.select("lang", "source", "item", (F.col("terms") * (diverged(F.col("p"), F.col("other_base")) - both)).alias("part"))
        theirs = bars.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"), "p", "terms")
        theirs = theirs.join(beside(written(each.drop("kept"))), "lang").where(F.col("source") != F.col("item"))
        theirs = theirs.select("lang", "source", "item", (F.col("terms") * (diverged(F.col("base"), F.col("p")) - both)).alias("part"))
        return mine.unionByName(theirs)

    def _shared(self) -> DataFrame:
        """What terms that both groups hold change beyond that. A term's sources stand in lists of about ``BLOCK``; lists meet in pairs."""
        widest = self.groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
        blocks = max(1, -(-widest // BLOCK))
        lists = self.shares.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)))
        lists = lists.groupBy("lang", "term", "block").agg(F.collect_list(F.struct("source", "p", "base")).alias("a")).drop("block")
        if blocks > 1:
            lists = written(lists)
            lists = lists.join(lists.withColumnRenamed("a", "b"), ["lang", "term"])
        else:
            lists = lists.where(F.size("a") > 1).withColumn("b", F.col("a"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lang, sides = batch.column(0).dictionary_encode(), []
                for column in batch.columns[1:]:
                    flat = column.flatten()
                    names = flat.field(0).dictionary_encode()
                    sizes = np.diff(column.offsets.to_numpy())
                    sides.append((np.cumsum(sizes) - sizes, sizes, names.indices.to_numpy(), names.dictionary, *(flat.field(k).to_numpy() for k in (1, 2))))
                (at_a, n_a, s_a, names_a, p_a, z_a), (at_b, n_b, s_b, names_b, p_b, z_b) = sides
                work = np.cumsum(n_a * n_b)
                for row in np.split(np.arange(len(work)), np.flatnonzero(np.diff(work // PAIRS)) + 1):
                    left = ragged(at_a[row], n_a[row])
                    times = np.repeat(n_b[row], n_a[row])
                    i = np.repeat(left, times)
                    j = ragged(np.repeat(at_b[row], n_a[row]), times)
                    of = np.repeat(np.repeat(lang.indices.to_numpy()[row], n_a[row]), times).astype(np.int64)
                    p, q, y, z = p_a[i], p_b[j], z_a[i], z_b[j]
                    f = lambda x, u: (x - u) * (x - u) // u
                    part = f(p, q) - f(p, z) - f(y, q) + f(y, z)
                    key = (of * len(names_a) + s_a[i]) * len(names_b) + s_b[j]
                    order = np.argsort(key, kind="stable")
                    found, first = np.unique(key[order], return_index=True)
                    sums = np.add.reduceat(part[order], first) if len(first) else part[:0]
                    a, b = found // len(names_b), found % len(names_b)
                    yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(a // len(names_a))), names_a.take(pa.array(a % len(names_a))), names_b.take(pa.array(b)), pa.array(sums)], ["lang", "source", "item", "part"])

        parts = lists.select("lang", "a", "b").mapInArrow(spared(run), "lang string, source string, item string, part long")
        return parts.where(F.col("source") != F.col("item"))

    def leading(self, most: int = LEADING) -> DataFrame:
        """lang, source, item (a term above the language's share), value, rank: the ``most`` first of each group."""
        above = self.shares.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), diverged(F.col("p"), F.col("q")).alias("value"))
        return radix_top(above, ["lang", "source"], "value", "item", most)


def _threshold(bins: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The bin of each group in which the ``need``-th row stands: what is needed of it, and its size."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    upto = bins.withColumn("upto", F.sum("size").over(w))
    hit = upto.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("size") < F.col("need")))
    return hit.withColumn("need", F.col("need") - F.col("upto") + F.col("size")).drop("upto")


def radix_top(rows: DataFrame, by: list[str], value: str, item: str, most: int) -> DataFrame:
    """The ``most`` first rows of every group with ``rank``: value (not negative) descending, then item by UTF-8 bytes.

    Items are distinct within a group. A group of more than ``FEW`` rows is narrowed by histograms of ``BITS`` bits of the
    value, from the top, then of ``BYTES`` bytes of the item (behind what the open ones have in common), until the bin of
    the last place holds ``FEW`` rows; so no task ranks more than ``most + FEW`` rows of a group, however large.
    """
    rows = written(rows)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.max(value).alias("top"))
    top = sizes.agg(F.max("top")).first()[0]
    few = max(FEW, most)
    # Open groups: rows of value >> shift == bin hold the last place; need: how many of these are still to be taken.
    state = written(sizes.where(F.col("size") > few).select(*by, F.lit(most).cast("long").alias("need"), F.lit(0).cast("long").alias("bin")))
    done, shift = [], -(-(top or 0).bit_length() // BITS) * BITS
    v = F.col(value)
    while shift and not state.isEmpty():
        opened = rows.join(beside(state), by).where(F.shiftright(v, shift) == F.col("bin"))
        shift -= BITS
        bins = opened.groupBy(*by, "need", F.shiftright(v, shift).alias("bin")).agg(F.count(F.lit(1)).alias("size"))
        found = written(_threshold(bins, by, F.desc("bin")))
        done.append(found.where(F.col("size") <= few).select(*by, (F.col("bin") * F.lit(1 << shift)).alias("least"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("binary").alias("head")))
        state = found.where(F.col("size") > few).drop("size")
    text = F.encode(F.col(item), "UTF-8")
    state = state.withColumns({"width": F.lit(0), "head": F.lit(b"")})
    while not state.isEmpty():  # only equal values are left: bin is that value
        opened = rows.join(beside(state), by).where((v == F.col("bin")) & (F.substring(text, F.lit(1), F.col("width")) == F.col("head"))).withColumn("_text", text)
        ends = opened.groupBy(*by).agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"))
        same = F.expr("least(length(_low), length(_high))")
        parted = F.expr("array_position(transform(sequence(1, greatest(least(length(_low), length(_high)), 1)), i -> substring(_low, i, 1) != substring(_high, i, 1)), true)")
        ends = written(ends.select(*by, (F.when(parted > 0, parted - 1).otherwise(same) + BYTES).cast("int").alias("_width")))
        bins = opened.join(beside(ends), by).groupBy(*by, "need", F.col("bin"), F.col("_width").alias("width"), F.expr("substring(_text, 1, _width)").alias("head")).agg(F.count(F.lit(1)).alias("size"))
        found = written(_threshold(bins, by, F.asc("head")))
        done.append(found.where(F.col("size") <= few).select(*by, F.col("bin").alias("least"), "width", "head"))
        state = written(found.where(F.col("size") > few).drop("size"))
    kept = rows
    if done:
        limits = done[0]
        for d in done[1:]:
            limits = limits.unionByName(d)
        kept = rows.join(beside(written(limits)), by, "left")
        behind = (v == F.col("least")) & F.col("width").isNotNull() & (F.substring(text, F.lit(1), F.coalesce("width", F.lit(0))) > F.col("head"))
        kept = kept.where(F.col("least").isNull() | (v >= F.col("least")) & ~F.coalesce(behind, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.asc(item)))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).select(*by, item, value, "rank")


def audit(docs: DataFrame, column: str = "text", most: int = LEADING) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    found = Audit(docs, column)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    pairs = found.pairs().withColumn("rank", rank)
    pick = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return pick(pairs, "pair").unionByName(pick(found.leading(most), "term"))
