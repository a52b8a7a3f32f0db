"""Full-text search: index tables, term expansion, BM25+ scores, threshold, proximity."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.functions import text as T
from quern.sources.durable import bounded, written

# BM25+ parameters, weights of match classes, caps of expansion.
K1, B, DELTA = 1.2, 0.75, 0.5
EXACT, VARIANT, PREFIX, ONE_EDIT, MORE_EDITS = 1.0, 0.9, 0.75, 0.6, 0.4
PREFIX_TOKENS, SHORT_PREFIX_TOKENS, PREFIX_POSTINGS = 50, 10, 2_000
TYPO_TOKENS, TYPO_POSTINGS = 20, 1_000
QUERY_TOKENS = 32
DICTIONARY_GUARD = 200_000


@dataclass(frozen=True)
class Term:
    """A query term and what it may stand for: edits allowed, other forms, longer words."""

    text: str
    edits: int = 0
    forms: list[str] = field(default_factory=list)
    prefix: bool = True


class Index:
    """Postings, dictionary and field statistics of some text fields, as DataFrames."""

    def __init__(self, docs: DataFrame, pk: str, fields: list[str], tokenize=T.tokens):
        for f in fields:
            if f not in docs.columns:
                raise QueryError("unknown_search_field", f)
        self.pk = pk
        each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))
        if any(dict(docs.dtypes)[f].startswith("array") for f in fields):  # a field of several values: tokens of all of them
            many = lambda f: F.col(f) if dict(docs.dtypes)[f].startswith("array") else F.when(F.col(f).isNotNull(), F.array(f))
            each = F.array(*(F.struct(F.lit(f).alias("field"), many(f).alias("text")) for f in fields))
            tokenize = T.list_tokens if tokenize is T.tokens else lambda c, one=tokenize: F.flatten(F.transform(F.array_compact(c), one))
        bounded(docs.sparkSession)
        self.present, self.tokenize, self._slices = docs.select(pk, F.inline(each)).where("text is not null"), tokenize, {}
        self.words = self.split(self.present)
        self.lengths = self.words.select(pk, "field", F.size("words").cast("long").alias("len"))
        self.tokens = self.words.select(pk, "field", F.explode("words").alias("token"))
        self.postings = self.tokens.groupBy("field", "token", pk).agg(F.count(F.lit(1)).alias("tf"))
        self.dictionary = self.postings.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))
        self.stats = self._counted()

    def split(self, present: DataFrame) -> DataFrame:
        return present.select(self.pk, "field", self.tokenize(F.col("text")).alias("words"))

    def placed(self) -> DataFrame:
        """Postings with the places of every token in its field's list of tokens."""
        each = self.words.select(self.pk, "field", F.posexplode("words").alias("place", "token"))
        return each.groupBy("field", "token", self.pk).agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("place")).alias("places"))

    def places(self, tokens: DataFrame, keys: DataFrame) -> DataFrame:
        """pk, field, term, at: where the tokens of each term stand in the documents of ``keys`` (a page at most)."""
        own = self.split(self.present.join(F.broadcast(keys), self.pk)).select(self.pk, "field", F.posexplode("words").alias("place", "token"))
        return gathered(own.join(F.broadcast(tokens.select("field", "term", "token")), ["field", "token"]), self.pk, F.collect_list("place"))

    def slice(self, terms: list[Term]) -> DataFrame:
        """The part of the dictionary in which the terms are looked up, from one pass over the texts.

        The pass writes every field's length and those of its tokens that a term may stand for, so only these are ever shuffled;
        ``hits``, ``lengths`` and ``stats`` read what it wrote.
        """
        key = tuple(sorted((t.text, t.edits, tuple(t.forms), t.prefix) for t in terms))
        if key not in self._slices:
            if self.tokenize is T.tokens and not any(t.edits or t.prefix for t in terms):
                rows = self.present.select(self.pk, "field", T.met_tokens(F.col("text"), frozenset(w for t in terms for w in (t.text, *t.forms))).alias("m")).select(self.pk, "field", "m.*")
            else:
                stands = lambda t: reduce(Column.__or__, (kind_of(t, p)[0].isNotNull() for p in terms))
                rows = self.words.select(self.pk, "field", F.size("words").cast("long").alias("len"), F.filter("words", stands).alias("met"))
            met = written(rows)
            self.lengths = met.select(self.pk, "field", "len")
            self.stats = self._counted()
            tokens = met.select(self.pk, "field", F.explode("met").alias("token"))
            found = tokens.groupBy("field", "token", self.pk).count().groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))
            found._tokens = tokens
            self._slices[key] = found
        return self._slices[key]

    def _counted(self) -> DataFrame:
        return self.lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("total_len"))

    def crowded(self) -> bool:
        return not self.dictionary.groupBy("field").count().where(F.col("count") > DICTIONARY_GUARD).isEmpty()

    def hits(self, tokens: DataFrame) -> DataFrame:
        """Postings of the tokens (field, token, term, weight, df) with lengths; other tokens are dropped before any shuffle."""
        met = getattr(tokens, "_tokens", self.tokens).join(F.broadcast(tokens), ["field", "token"])  # capped per term
        met = met.groupBy("field", "token", self.pk, "term", "weight", "df").agg(F.count(F.lit(1)).alias("tf"))
        return met.join(self.lengths, [self.pk, "field"])

    def report(self) -> DataFrame:
        """field, docs, words, single_use, entries."""
        d = self.dictionary.groupBy("field").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("df") == 1).alias("single_use"), F.sum("df").alias("entries"))
        return self.stats.join(d, "field").select("field", F.col("n_docs").alias("docs"), "words", "single_use", "entries")


def query_terms(query: str) -> list[str]:
    return sorted(set(T.tokens_of(query)[:QUERY_TOKENS]))


def kind_of(t: Column, p: Term) -> tuple[Column, Column]:
    """What token ``t`` is to a term (0 the word, 1 another form, 2 a longer word, 3 a typo; else null), and its distance."""
    near = F.length(t).between(len(p.text) - p.edits, len(p.text) + p.edits)  # most tokens need no distance
    distance = F.when(near, F.levenshtein(t, F.lit(p.text), p.edits)).otherwise(-1) if p.edits else F.lit(-1)
    kind = F.when(t == p.text, F.lit(0))
    kind = kind.when(t.isin(*p.forms), F.lit(1)) if p.forms else kind
    kind = kind.when(t.startswith(p.text), F.lit(2)) if p.prefix else kind
    return kind.when(distance >= 1, F.lit(3)) if p.edits else kind, distance


def expanded(index: Index, terms: list[str], exact: bool = False, tolerance: int | None = None, guard: bool = False) -> DataFrame:
    """field, term, token, weight: what each query term stands for in each field's dictionary.

    The query is small; the dictionary is scanned once with one condition per term, then capped per
    (field, term, class) by document frequency. ``guard``: no typos, for dictionaries past the guard.
    """
    planned = []
    for term in terms:
        edits = 0 if exact or guard and tolerance is None else T.tolerance(term) if tolerance is None else min(max(tolerance, 0), 3)
        planned.append(Term(term, edits, [] if exact else T.variants(term), not exact))
    d, parts = index.slice(planned) if planned else index.dictionary, []
    for p in planned:
        kind, distance = kind_of(F.col("token"), p)
        parts.append(F.struct(F.lit(p.text).alias("term"), kind.alias("kind"), distance.alias("distance")))
    if not parts:
        return d.limit(0).select("field", F.lit("").alias("term"), "token", F.lit(0.0).alias("weight"))
    hits = d.select("field", "token", "df", F.inline(F.filter(F.array(*parts), lambda p: p["kind"].isNotNull())))
    rank = Window.partitionBy("field", "term", "kind").orderBy(F.when(F.col("kind") == 3, F.col("distance")).otherwise(0), F.desc("df"), "token")
    cap = F.when(F.col("kind") < 2, 1 << 30).when(F.col("kind") == 3, TYPO_TOKENS).when(F.length("term") <= 2, SHORT_PREFIX_TOKENS).otherwise(PREFIX_TOKENS)
    budget = F.when(F.col("kind") == 3, TYPO_POSTINGS).otherwise(PREFIX_POSTINGS)
    hits = hits.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= cap)
    hits = hits.withColumn("cum", F.sum("df").over(rank.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("kind") < 2) | (F.col("rn") == 1) | (F.col("cum") <= budget))
    weight = F.when(F.col("kind") == 0, EXACT).when(F.col("kind") == 1, VARIANT).when(F.col("kind") == 2, PREFIX).when(F.col("distance") == 1, ONE_EDIT).otherwise(MORE_EDITS)
    out = hits.select("field", "term", "token", weight.alias("weight"), "df")
    if hasattr(d, "_tokens"):
        out._tokens = d._tokens
    return out


def bm25(tf: Column, df: Column, length: Column, n: Column, total: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * T.quantized(length) / (total / n))) + DELTA)


def scored(index: Index, terms: list[str], boosts: dict[str, float] | None = None, **how) -> DataFrame:
    """pk, score, hits (distinct query terms met): sums in a fixed order, so reruns agree to the last bit."""
    pk = index.pk
    boost = F.lit(1.0)
    for field, value in (boosts or {}).items():
        boost = F.when(F.col("field") == field, F.lit(float(value))).otherwise(boost)
    found = index.hits(expanded(index, terms, **how)).join(F.broadcast(index.stats), "field")  # one row a field
    part = boost * F.col("weight") * bm25(F.col("tf"), F.col("df"), F.col("len"), F.col("n_docs"), F.col("total_len"))
    parts = F.array_sort(F.collect_list(F.struct("field", "term", "token", part.alias("part"))))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["part"])
    return found.groupBy(pk).agg(total.alias("score"), F.count_distinct("term").alias("hits"))


def passing(scores: DataFrame, pk: str, n_terms: int, threshold: float = 1.0) -> DataFrame:
    """0: documents with all terms; 1: any; between: all, and that share of the rest by score."""
    if threshold >= 1:
        return scores
    scores = written(scores) if threshold > 0 else scores  # read three times below
    every = scores.where(F.col("hits") == n_terms)
    if threshold <= 0:
        return every
    rest = scores.where(F.col("hits") < n_terms)
    take = -int(-(rest.count() * threshold) // 1)
    return every.unionByName(rest.orderBy(F.desc("score"), pk).limit(take))


def gathered(rows: DataFrame, pk: str, at: Column) -> DataFrame:
    return rows.groupBy(pk, "field", "term").agg(at.alias("at"))


def near(index, scores: DataFrame, words: list[str], top: int = 100, **how) -> DataFrame:
    """The ``top`` documents re-ranked: score * (1 + half the best field's share of adjacent query pairs).

    A pair is adjacent where any token that its first word matched (itself, a variant, a longer word, a typo) stands right
    before one that the second matched. Positions are looked up for the ``top`` documents only.
    """
    pk, words = index.pk, list(dict.fromkeys(words))
    best = written(scores.orderBy(F.desc("score"), pk).limit(top))
    pairs = list(zip(words, words[1:], strict=False))
    if not pairs:
        return best.select(pk, "score")
    places = index.places(expanded(index, words, **how), best.where("hits >= 2").select(pk))
    each = places.groupBy(pk, "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("at"))
    of = lambda w: F.try_element_at("at", F.lit(w))
    meets = lambda a, b: F.coalesce(F.arrays_overlap(F.transform(of(a), lambda x: x + 1), of(b)), F.lit(False)).cast("int")
    share = sum((meets(a, b) for a, b in pairs), F.lit(0)) / len(pairs)
    shares = each.groupBy(pk).agg(F.max(share).alias("share"))
    return best.join(F.broadcast(shares), pk, "left").select(pk, (F.col("score") * (1 + 0.5 * F.coalesce("share", F.lit(0.0)))).alias("score"))  # top rows


def guarded(index, tolerance: int | None) -> bool:
    """Whether a field's dictionary is past the size at which typos are matched unasked."""
    return tolerance is None and index.crowded()


def search(docs: DataFrame, pk: str, query: str, fields: list[str], boosts: dict[str, float] | None = None, threshold: float = 1.0, tokenize=T.tokens, **how) -> DataFrame:
    """pk and score of the documents that match."""
    terms, index = query_terms(query), Index(docs, pk, fields, tokenize)
    if not how.get("exact"):
        how.setdefault("guard", guarded(index, how.get("tolerance")))
    return passing(scored(index, terms, boosts, **how), pk, len(terms), threshold).select(pk, "score")
