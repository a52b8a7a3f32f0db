"""Registered queries over the synthetic tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import geo, scalars, text
from quern.operators import diff, entity, facets, keyed, order, relations, similarity
from quern.operators.where import where
from quern.plans import search as plan
from quern.sources.durable import bounded, tasks
from quern.sources.tables import execute, execute_many, scan, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function by its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _filtered(name: str, source: str, condition: dict, sql: str, pk: str, *more: str):
    """A filter query: keys (and some columns) of the rows that match."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return where(scan(spark, sf, source), condition).select(pk, *more)

    run.__name__ = name
    query(f"SELECT {', '.join((pk, *more))} FROM {source} WHERE {sql}")(run)


_filtered("where_scalar_ops", "orders", {"o_totalprice": {"gte": 100000, "lt": 300000}, "o_orderstatus": "F"}, "o_totalprice >= 100000 AND o_totalprice < 300000 AND o_orderstatus = 'F'", "o_orderkey", "o_totalprice")
_filtered("where_in_notin", "orders", {"o_orderstatus": ["F", "O"], "o_orderpriority": {"not_in": ["1-URGENT", "2-HIGH"]}}, "o_orderstatus IN ('F','O') AND o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('1-URGENT','2-HIGH')", "o_orderkey", "o_orderpriority")
_filtered("where_between", "lineitem", {"l_quantity": {"between": [10, 20]}, "l_discount": {"gt": 0.05}}, "l_quantity BETWEEN 10 AND 20 AND l_discount > 0.05", "l_orderkey", "l_linenumber", "l_quantity")
_filtered("where_and_or_not", "customer", {"or": [{"c_mktsegment": "BUILDING"}, {"and": [{"c_acctbal": {"lt": 0}}, {"not": {"c_nationkey": [1, 2, 3]}}]}]}, "c_mktsegment = 'BUILDING' OR (c_acctbal < 0 AND NOT c_nationkey IN (1,2,3))", "c_custkey", "c_acctbal")
_filtered("where_empty_lists", "customer", {"or": [{"c_mktsegment": []}, {"and": []}, {"c_name": None}, {"c_acctbal": {"gt": 9000}}]}, "c_acctbal > 9000", "c_custkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders) WHERE NOT coalesce(price > 100000, false)")
def where_null_not(spark, sf):
    """``not`` also passes rows that lack the field."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"))
    return where(rows, {"not": {"price": {"gt": 100000}}}).select("o_orderkey")


_BASKETS = "SELECT l_orderkey, list(l_partkey % 50) AS parts, list(l_quantity) AS quantities FROM lineitem GROUP BY l_orderkey"


@query(f"SELECT l_orderkey FROM ({_BASKETS}) WHERE list_contains(parts, 7) AND len(list_filter(quantities, lambda x: x > 30)) > 0 AND NOT (list_contains(parts, 3) OR list_contains(parts, 4))")
def where_array_ops(spark, sf):
    baskets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 50).alias("parts"), F.collect_list("l_quantity").alias("quantities"))
    return where(baskets, {"parts": {"contains_all": [7], "not_in": [3, 4]}, "quantities": {"gt": 30}}).select("l_orderkey")


_PLACED = "SELECT c_custkey, (c_custkey * 3701 % 18000) / 100.0 - 90 AS lat, (c_custkey * 9103 % 36000) / 100.0 - 180 AS lon FROM customer"


def _placed(spark, sf):
    k = F.col("c_custkey")
    point = F.struct((k * 3701 % 18000 / 100.0 - 90).alias("lat"), (k * 9103 % 36000 / 100.0 - 180).alias("lon")).alias("place")
    return table(spark, sf, "customer").select("c_custkey", point)


_DISTANCE = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(47.0)) / 2), 2) + cos(radians(lat)) * cos(radians(47.0)) * pow(sin((radians(lon) - radians(8.5)) / 2), 2))))"


@query(f"SELECT c_custkey, round({_DISTANCE} / 1000, 3) AS km FROM ({_PLACED}) WHERE {_DISTANCE} <= 9000000")
def geo_radius(spark, sf):
    near = where(_placed(spark, sf), {"place": {"radius": {"center": [47.0, 8.5], "value": 9000, "unit": "km"}}})
    return near.select("c_custkey", F.round(geo.haversine(F.col("place.lat"), F.col("place.lon"), 47.0, 8.5) / 1000, 3).alias("km"))


@query(f"SELECT c_custkey FROM ({_PLACED}) WHERE NOT (lat >= -20 AND lat < 50 AND lon >= -30 AND lon < 60)")
def geo_polygon_outside(spark, sf):
    box = [[-20.0, -30.0], [50.0, -30.0], [50.0, 60.0], [-20.0, 60.0]]
    return where(_placed(spark, sf), {"place": {"polygon": {"points": box, "inside": False}}}).select("c_custkey")


@query("SELECT o_orderkey, price FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price FROM orders) ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 50")
def order_nulls_last_page(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("price"))
    return order.page(rows, [("price", "desc")], "o_orderkey", limit=100, offset=50)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 300000 OR (o_totalprice = 300000 AND o_orderkey > 10) ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def cursor_page(spark, sf):
    token = order.cursor("o_totalprice", "desc", 300000, 10)
    rows = order.after(table(spark, sf, "orders"), "o_orderkey", token)
    return order.page(rows, [("o_totalprice", "desc")], "o_orderkey", limit=100).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1")
def distinct_on_first(spark, sf):
    return order.first_of(table(spark, sf, "orders"), "o_custkey", [("o_totalprice", "desc")], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT source AS value, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def facet_string(spark, sf):
    return facets.values(table(spark, sf, "documents"), "source")


@query("SELECT * FROM (SELECT 0.0::DOUBLE AS low, 100000.0::DOUBLE AS high, count(*) FILTER (o_totalprice BETWEEN 0 AND 100000) AS count FROM orders UNION ALL SELECT 50000.0, 200000.0, count(*) FILTER (o_totalprice BETWEEN 50000 AND 200000) FROM orders UNION ALL SELECT -5.0, -1.0, count(*) FILTER (o_totalprice BETWEEN -5 AND -1) FROM orders)")
def facet_number(spark, sf):
    return facets.ranges(table(spark, sf, "orders"), "o_totalprice", [(0, 100000), (50000, 200000), (-5, -1)])


@query("SELECT true AS value, count(*) FILTER (l_discount > 0.05) AS count FROM lineitem UNION ALL SELECT false, count(*) FILTER (NOT l_discount > 0.05) FROM lineitem")
def facet_boolean(spark, sf):
    return facets.flags(table(spark, sf, "lineitem").select((F.col("l_discount") > 0.05).alias("cheap")), "cheap")


@query("SELECT value, count(*) AS count FROM (SELECT unnest(string_split(p_type, ' ')) AS value FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def facet_array(spark, sf):
    return facets.values(table(spark, sf, "part").select(F.split("p_type", " ").alias("kinds")), "kinds")


@query("SELECT o_orderkey, c_name AS customer, n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def fk_expand(spark, sf):
    customers = relations.expand(table(spark, sf, "customer"), "c_nationkey", table(spark, sf, "nation"), "n_nationkey", "nation")
    rows = relations.expand(table(spark, sf, "orders"), "o_custkey", customers, "c_custkey", "customer")
    return rows.select("o_orderkey", F.col("customer.c_name").alias("customer"), F.col("customer.nation.n_name").alias("nation"))


@query("SELECT l_orderkey, l_linenumber, p_brand || ' x ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS title FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def fk_derived(spark, sf):
    title = F.concat(F.col("p_brand"), F.lit(" x "), F.col("l_quantity").cast("long").cast("string"))
    return relations.derived(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part"), "p_partkey", title=title).select("l_orderkey", "l_linenumber", "title")


@query("SELECT o_orderkey, c_name AS old_value, c_name || '!' AS new_value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 4 = 0")
def cascade_dependents(spark, sf):
    before = table(spark, sf, "customer")
    after = before.withColumn("c_name", F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return relations.dependents(table(spark, sf, "orders"), "o_custkey", before, after, "c_custkey", "c_name").select("o_orderkey", "old_value", "new_value")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0) ON o_custkey = c_custkey")
def fk_set_null(spark, sf):
    gone = table(spark, sf, "customer").where("c_custkey % 6 = 0")
    return relations.enforce(table(spark, sf, "orders"), "o_custkey", gone, "c_custkey", "set_null").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_fk(spark, sf):
    return relations.enforce(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey", "cascade").select("c_custkey")


# Text search on words of ASCII letters, which both engines split alike.
_WORDS = "SELECT doc_id, 'text' AS field, list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL"
_POSTINGS = f"postings AS (SELECT doc_id, field, token, count(*) AS tf FROM (SELECT doc_id, field, unnest(words) AS token FROM ({_WORDS})) GROUP BY ALL), dictionary AS (SELECT field, token, count(*) AS df FROM postings GROUP BY ALL), lengths AS (SELECT doc_id, field, len(words) AS len FROM ({_WORDS})), stats AS (SELECT field, count(*) AS n_docs, sum(len) AS total_len FROM lengths GROUP BY field)"
_QUANT = "CASE WHEN len < 32 THEN len ELSE (len >> (length(bin(len)) - 5)::INT) << (length(bin(len)) - 5)::INT END"
_PART = f"weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ({_QUANT}) / (total_len / n_docs))) + 0.5)"


# The SQL has no other words, so the queries beside it index with simple_tokens; ``TOKENIZED`` runs all of them on full tokens.
def _index(spark, sf, tokenize):
    return plan.Index(table(spark, sf, "documents"), "doc_id", ["text"], tokenize)


@query(f"WITH {_POSTINGS} SELECT doc_id, token, tf FROM postings")
def term_frequencies(spark, sf, tokenize=text.simple_tokens):
    return _index(spark, sf, tokenize).postings.select("doc_id", "token", "tf")


@query(f"WITH {_POSTINGS} SELECT token, df FROM dictionary")
def doc_frequencies(spark, sf, tokenize=text.simple_tokens):
    return _index(spark, sf, tokenize).dictionary.select("token", "df")


@query(f"WITH {_POSTINGS} SELECT s.field, n_docs AS docs, count(*) AS words, count(*) FILTER (df = 1) AS single_use, sum(df)::BIGINT AS entries FROM stats s JOIN dictionary d ON s.field = d.field GROUP BY ALL")
def index_report(spark, sf, tokenize=text.simple_tokens):
    return _index(spark, sf, tokenize).report()


def _bm25_sql(expansion: str) -> str:
    return f"WITH {_POSTINGS}, expansion AS ({expansion}), found AS (SELECT doc_id, term, {_PART} AS part FROM postings JOIN expansion USING (field, token) JOIN dictionary USING (field, token) JOIN lengths USING (doc_id, field) JOIN stats USING (field)), scores AS (SELECT doc_id, sum(part) AS score, count(DISTINCT term) AS hits FROM found GROUP BY doc_id)"


_EXACT = "SELECT 'text' AS field, unnest(['the', 'thing', 'was']) AS term, unnest(['the', 'thing', 'was']) AS token, 1.0 AS weight"


@query(_bm25_sql(_EXACT) + " SELECT doc_id, round(score, 6) AS score, hits FROM scores")
def bm25_exact(spark, sf, tokenize=text.simple_tokens):
    return plan.scored(_index(spark, sf, tokenize), plan.query_terms("the thing was"), exact=True).select("doc_id", F.round("score", 6).alias("score"), "hits")


_KINDS = "SELECT field, term, token, df, distance, CASE WHEN token = term THEN 0 WHEN list_contains(forms, token) THEN 1 WHEN starts_with(token, term) THEN 2 WHEN edits > 0 AND distance <= edits THEN 3 END AS kind FROM (SELECT d.*, q.*, levenshtein(d.token, q.term) AS distance FROM dictionary d, (SELECT unnest(['thing', 'there']) AS term, unnest([['things'], ['theres']]) AS forms, 1 AS edits) q)"
_EXPANSION = f"SELECT field, term, token, CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.75 ELSE 0.6 END AS weight FROM (SELECT *, row_number() OVER w AS rn, sum(df) OVER w AS cum FROM ({_KINDS}) WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY field, term, kind ORDER BY CASE WHEN kind = 3 THEN distance ELSE 0 END, df DESC, token ROWS UNBOUNDED PRECEDING)) WHERE kind < 2 OR (rn <= CASE WHEN kind = 3 THEN 20 ELSE 50 END AND (rn = 1 OR cum <= CASE WHEN kind = 3 THEN 1000 ELSE 2000 END))"


@query(_bm25_sql(_EXPANSION) + " SELECT doc_id, round(score, 6) AS score, hits FROM scores")
def bm25_prefix_typo(spark, sf, tokenize=text.simple_tokens):
    return plan.scored(_index(spark, sf, tokenize), plan.query_terms("thing there")).select("doc_id", F.round("score", 6).alias("score"), "hits")


@query(_bm25_sql(_EXACT) + ", rest AS (SELECT * FROM scores WHERE hits < 3), ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rn, count(*) OVER () AS n FROM rest) SELECT doc_id FROM scores WHERE hits = 3 UNION ALL SELECT doc_id FROM ranked WHERE rn <= ceil(n * 0.25)")
def search_threshold(spark, sf, tokenize=text.simple_tokens):
    scores = plan.scored(_index(spark, sf, tokenize), plan.query_terms("the thing was"), exact=True).withColumn("score", F.round("score", 9))
    return plan.passing(scores, "doc_id", 3, 0.25).select("doc_id")


@query(_bm25_sql(_EXACT) + f", best AS (SELECT *, round(score, 9) AS s FROM scores ORDER BY s DESC, doc_id LIMIT 100), shares AS (SELECT doc_id, (contains(t, ' the  thing ')::INT + contains(t, ' thing  was ')::INT) / 2.0 AS share FROM (SELECT doc_id, ' ' || array_to_string(words, '  ') || ' ' AS t FROM ({_WORDS}))) SELECT doc_id, round(s * (1 + 0.5 * CASE WHEN hits >= 2 THEN share ELSE 0 END), 6) AS score FROM best JOIN shares USING (doc_id)")
def proximity_rerank(spark, sf, tokenize=text.simple_tokens):
    index = _index(spark, sf, tokenize)
    scores = plan.scored(index, plan.query_terms("the thing was"), exact=True).withColumn("score", F.round("score", 9))
    return plan.near(index, scores, ["the", "thing", "was"], exact=True).select("doc_id", F.round("score", 6).alias("score"))


def _expansion_sql(terms: list[str], forms: list[list[str]], edits: list[int]) -> str:
    kinds = f"SELECT field, term, token, df, distance, CASE WHEN token = term THEN 0 WHEN list_contains(forms, token) THEN 1 WHEN starts_with(token, term) THEN 2 WHEN edits > 0 AND distance <= edits THEN 3 END AS kind FROM (SELECT d.*, q.*, levenshtein(d.token, q.term) AS distance FROM dictionary d, (SELECT unnest({terms}) AS term, unnest({forms}::VARCHAR[][]) AS forms, unnest({edits}) AS edits) q)"
    return f"SELECT field, term, token, CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.75 ELSE 0.6 END AS weight FROM (SELECT *, row_number() OVER w AS rn, sum(df) OVER w AS cum FROM ({kinds}) WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY field, term, kind ORDER BY CASE WHEN kind = 3 THEN distance ELSE 0 END, df DESC, token ROWS UNBOUNDED PRECEDING)) WHERE kind < 2 OR (rn <= CASE WHEN kind = 3 THEN 20 WHEN length(term) <= 2 THEN 10 ELSE 50 END AND (rn = 1 OR cum <= CASE WHEN kind = 3 THEN 1000 ELSE 2000 END))"


_MATCHED = (
    _bm25_sql(_expansion_sql(["the", "thing", "wa"], [["thes"], ["things"], []], [0, 1, 0]))
    + f", best AS (SELECT *, round(score, 9) AS s FROM scores ORDER BY s DESC, doc_id LIMIT 100), places AS (SELECT doc_id, term, place FROM (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS place FROM ({_WORDS})) JOIN expansion USING (token)), shares AS (SELECT a.doc_id, count(DISTINCT a.term) / 2.0 AS share FROM places a JOIN places b ON a.doc_id = b.doc_id AND b.place = a.place + 1 AND (a.term, b.term) IN (('the', 'thing'), ('thing', 'wa')) GROUP BY 1) SELECT doc_id, round(s * (1 + 0.5 * CASE WHEN hits >= 2 THEN coalesce(share, 0) ELSE 0 END), 6) AS score FROM best LEFT JOIN shares USING (doc_id)"
)


@query(_MATCHED)
def proximity_matched(spark, sf, tokenize=text.simple_tokens):
    """Adjacent pairs of whatever the words matched: the last one is only the beginning of a word."""
    index = _index(spark, sf, tokenize)
    scores = plan.scored(index, plan.query_terms("the thing wa")).withColumn("score", F.round("score", 9))
    return plan.near(index, scores, ["the", "thing", "wa"]).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT lang AS value, count(*) AS count FROM documents WHERE len(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' '), lambda x: x = 'the')) > 0 AND lang IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def search_facet(spark, sf, tokenize=text.simple_tokens):
    hits = plan.search(table(spark, sf, "documents"), "doc_id", "the", ["text"], tokenize=tokenize, exact=True)
    return facets.values(table(spark, sf, "documents").join(hits, "doc_id", "left_semi"), "lang")


_UNIT = "list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))::FLOAT)"
_QVEC = [1.0, 0.5, -0.25, 0.125] * 16
_QUNIT = similarity.unit(_QVEC)


@query(f"SELECT vec_id, round(s, 5) AS similarity FROM (SELECT vec_id, list_inner_product({_UNIT}::DOUBLE[], {_QUNIT!r}::FLOAT[]::DOUBLE[]) AS s FROM embeddings WHERE len(embedding) = 64) WHERE s >= 0.15")
def vector_similarity(spark, sf):
    rows = similarity.similar(table(spark, sf, "embeddings").where("size(embedding) = 64"), "embedding", _QVEC, 0.15)
    return rows.select("vec_id", F.round("similarity", 5).alias("similarity"))


@query(_bm25_sql(_EXACT) + f", v AS (SELECT vec_id AS doc_id, list_inner_product({_UNIT}::DOUBLE[], {_QUNIT!r}::FLOAT[]::DOUBLE[]) AS score FROM embeddings WHERE len(embedding) = 64), vs AS (SELECT * FROM v WHERE score >= 0.1) SELECT doc_id, round(0.5 * coalesce(t.score / (SELECT max(score) FROM scores), 0) + 0.5 * coalesce(vs.score / (SELECT max(score) FROM vs), 0), 5) AS score FROM scores t FULL JOIN vs USING (doc_id)")
def hybrid_fusion(spark, sf, tokenize=text.simple_tokens):
    words = plan.scored(_index(spark, sf, tokenize), plan.query_terms("the thing was"), exact=True)
    near = similarity.similar(table(spark, sf, "embeddings").where("size(embedding) = 64"), "embedding", _QVEC, 0.1).select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
    return similarity.fused(words, near, "doc_id").select("doc_id", F.round("score", 5).alias("score"))


#: The search queries on the operator's own tokens, which SQL cannot split alike.
TOKENIZED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f"{f.__name__}_full": partial(f, tokenize=text.tokens)
    for f in (term_frequencies, doc_frequencies, index_report, bm25_exact, bm25_prefix_typo, search_threshold, proximity_rerank, search_facet, hybrid_fusion)
}


# Two versions of orders: some are deleted, some change, some are new.
_AFTER = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey + 100000000, o_custkey, 'N', NULL FROM orders WHERE o_orderkey % 13 = 0"
_FIELDS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def _versions(spark, sf):
    before = table(spark, sf, "orders").select(*_FIELDS)
    k = F.col("o_orderkey")
    kept = before.where(k % 11 != 0).withColumns({"o_orderstatus": F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(k % 5 != 0, F.col("o_orderpriority"))})
    new = before.where(k % 13 == 0).select((k + 100000000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))
    return before, kept.union(new)


def _change_sql() -> str:
    one = lambda c: f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS entity_id, CASE WHEN a.o_orderkey IS NULL THEN 'create' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS op, '{c}' AS field, a.{c}::VARCHAR AS previous, b.{c}::VARCHAR AS value FROM orders a FULL JOIN ({_AFTER}) b ON a.o_orderkey = b.o_orderkey WHERE a.{c} IS DISTINCT FROM b.{c}"
    return " UNION ALL ".join(map(one, _FIELDS[1:]))


def _log(spark, sf):
    before, after = _versions(spark, sf)
    rows = entity.changes(before, after, "o_orderkey").withColumnRenamed("o_orderkey", "entity_id")
    stamp = F.lit(1_700_000_000_000) + F.col("entity_id") % 1000
    return rows.withColumns({"operation_id": F.concat(F.lit("op"), (F.col("entity_id") % 10).cast("string")), "created_at": stamp})


@query(_change_sql())
def changelog_diff(spark, sf):
    return _log(spark, sf).select("entity_id", "op", "field", "previous", "value")


@query(f"SELECT entity_id, field, previous FROM (SELECT *, 1700000000000 + entity_id % 1000 AS created_at FROM ({_change_sql()})) WHERE created_at >= 1700000000500 ORDER BY created_at, entity_id, field LIMIT 500")
def changes_since(spark, sf):
    return entity.since(_log(spark, sf), 1_700_000_000_500).select("entity_id", "field", "previous")


@query(f"SELECT entity_id, CASE op WHEN 'create' THEN 'delete' WHEN 'delete' THEN 'recreate' ELSE 'restore' END AS action, field, previous AS value FROM ({_change_sql()}) WHERE entity_id % 10 = 3")
def revert_operation(spark, sf):
    """All that one operation changed; the cap of a single request does not hold for a whole table."""
    return entity.undo(_log(spark, sf), "op3", most=None).select("entity_id", "action", "field", "value")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders UNION ALL SELECT -1, 5, 'Z', NULL")
def merge_upsert(spark, sf):
    base = table(spark, sf, "orders").select(*_FIELDS)
    k = F.col("o_orderkey")
    patch = base.where(k % 3 == 0).select("o_orderkey", F.lit(None).cast("long").alias("o_custkey"), F.lit("P").alias("o_orderstatus"), F.when(k % 9 == 0, F.array(F.lit("o_orderpriority"))).alias("cleared"))
    new = base.sparkSession.createDataFrame([(-1, 5, "Z", None)], patch.schema)
    return entity.merge(base, patch.union(new), "o_orderkey", "cleared")


@query("SELECT event_id, max(epoch_us(ts) // 60000000 - rn) OVER (PARTITION BY user_id ORDER BY event_id) + rn AS stamp FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)")
def monotonic_clock(spark, sf):
    rows = table(spark, sf, "events").withColumn("minute", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60000))
    return rows.select("event_id", entity.clock(rows, "minute", "event_id", "user_id").alias("stamp"))


_FEED = "SELECT event_id, epoch_us(ts) // 3600000000 AS stamp, CASE WHEN event_id % 4 = 0 THEN 'deleted' WHEN event_id % 3 = 0 THEN 'created' ELSE 'updated' END AS kind FROM events"


def _feed(spark, sf):
    rows = table(spark, sf, "events").withColumn("updated_at", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3600000))
    live = rows.where("event_id % 4 <> 0").withColumn("created_at", F.when(F.col("event_id") % 3 == 0, F.col("updated_at")).otherwise(F.col("updated_at") - 1))
    return entity.feed(live, rows.where("event_id % 4 = 0").select("event_id", F.col("updated_at").alias("deleted_at")), "event_id")


@query(f"SELECT event_id, stamp, kind FROM (SELECT *, rank() OVER (ORDER BY stamp) AS r FROM ({_FEED}) WHERE stamp > 473400 AND stamp <= 480000) WHERE r <= 200")
def sync_page_asc(spark, sf):
    return entity.sync_page(_feed(spark, sf), "stamp", 473400, 480000, 200, "asc").select("event_id", "stamp", "kind")


@query(f"SELECT event_id, stamp, kind FROM (SELECT *, rank() OVER (ORDER BY stamp DESC) AS r FROM ({_FEED}) WHERE stamp >= 473400 AND stamp < 480000) WHERE r <= 200")
def sync_page_desc(spark, sf):
    return entity.sync_page(_feed(spark, sf), "stamp", 473400, 480000, 200, "desc").select("event_id", "stamp", "kind")


@query("SELECT user_id AS entity_id, bool_or(event_type = 'signup') AS created, arg_min(event_type, event_id) <> 'signup' AS existed, arg_min(value, event_id) AS before, count(*) AS changes FROM events GROUP BY user_id")
def cdc_coalesce(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("entity_id"), F.when(F.col("event_type") == "signup", "insert").otherwise("update").alias("op"), F.col("value").alias("before"))
    return entity.coalesced(rows)


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id * 1000 + CAST(floor(value) AS BIGINT) ORDER BY event_id) = 1")
def op_dedupe(spark, sf):
    rows = table(spark, sf, "events").withColumn("op_id", F.col("user_id") * 1000 + F.floor("value"))
    return keyed.first_by(rows, "op_id", ["event_id"]).select("event_id", "user_id")


_MS = "SELECT *, epoch_us(ts) // 1000 AS ms FROM events"


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


@query(f"SELECT user_id, session, min(ms) AS started, max(ms) AS ended, count(*) AS events FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, coalesce((ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) >= 86400000)::INT, 1) AS o FROM ({_MS}))) GROUP BY ALL")
def edit_sessions(spark, sf):
    return keyed.sessions(_events(spark, sf), "user_id", "ms", "event_id", 86_400_000)


@query("SELECT user_id, arg_max(event_type, struct_pack(a := value, b := event_id)) AS event_type, max(struct_pack(a := value, b := event_id)).a AS value, max(struct_pack(a := value, b := event_id)).b AS event_id FROM events GROUP BY user_id")
def presence_lww(spark, sf):
    return keyed.latest(table(spark, sf, "events"), "user_id", "event_type", ["value", "event_id"])


@query("SELECT user_id, count(*) AS tabs, bool_or(event_type = 'click') AS here, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END) AS status FROM events GROUP BY user_id")
def roster(spark, sf):
    kind = F.col("event_type")
    return keyed.roster(table(spark, sf, "events"), "user_id", F.when(kind == "view", 1).when(kind == "click", 2).otherwise(0), kind == "click")


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM ({_MS})),
b AS (SELECT event_id, user_id, n, ms AS at, 3::BIGINT AS have FROM e WHERE n = 1
UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN CASE WHEN b.have >= 1 THEN b.have - 1 ELSE b.have END + (e.ms - b.at) // 7200000 >= 3 THEN e.ms ELSE b.at + (e.ms - b.at) // 7200000 * 7200000 END, least(3, CASE WHEN b.have >= 1 THEN b.have - 1 ELSE b.have END + (e.ms - b.at) // 7200000) FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
SELECT user_id, event_id, have >= 1 AS allowed, CASE WHEN have >= 1 THEN have - 1 ELSE have END AS tokens FROM b""")
def token_bucket(spark, sf):
    return keyed.token_bucket(_events(spark, sf), "user_id", "ms", "event_id", capacity=3, refill=1, interval=7_200_000)


@query("SELECT event_id, CASE WHEN coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'dependency_failed' WHEN event_type = 'error' THEN 'rejected' ELSE 'sent' END AS status FROM events")
def outbox_fail(spark, sf):
    return keyed.outbox(table(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "status")


@query(f"SELECT user_id, max(ms) + 3600000 AS due_at FROM ({_MS}) GROUP BY 1 HAVING max(ms) + 3600000 <= 1706650000000")
def debounce_due(spark, sf):
    return keyed.debounced(_events(spark, sf), "user_id", "ms", 3_600_000, 1_706_650_000_000)


@query("SELECT doc_id, len(regexp_extract_all(text, '[^\\r\\n]*(\\r\\n|\\n|\\r)|[^\\r\\n]+$')) AS lines, true AS lossless FROM documents WHERE text IS NOT NULL")
def line_tokens(spark, sf):
    rows = table(spark, sf, "documents").where("text is not null").withColumn("l", diff.lines(F.col("text")))
    return rows.select("doc_id", F.size("l").cast("long").alias("lines"), (F.array_join("l", "") == F.col("text")).alias("lossless"))


@query("SELECT conv_id, turn, true AS old_side, true AS new_side FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL AND text IS NOT NULL")
def diff_words(spark, sf):
    """Word difference of every turn and the one before; both sides must come back."""
    bounded(spark)
    rows = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null and text is not null")
    rows = rows.repartition(tasks(spark)).withColumn("ops", diff.script(diff.words(F.col("before")), diff.words(F.col("text"))))  # few bytes, much work
    return rows.select("conv_id", "turn", (diff.side(F.col("ops"), "insert") == F.col("before")).alias("old_side"), (diff.side(F.col("ops"), "delete") == F.col("text")).alias("new_side"))


@query("SELECT l_orderkey, l_linenumber, a.p AS old_place, b.p AS new_place, CASE WHEN a.p IS NULL THEN 'inserted' WHEN b.p IS NULL THEN 'deleted' WHEN a.q IS DISTINCT FROM b.q THEN 'changed' ELSE 'unchanged' END AS status FROM (SELECT l_orderkey, l_linenumber, l_linenumber AS p, l_quantity AS q FROM lineitem WHERE l_partkey % 5 <> 0) a FULL JOIN (SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS p, CASE WHEN l_suppkey % 4 = 0 THEN l_quantity + 1 ELSE l_quantity END AS q FROM lineitem WHERE l_partkey % 7 <> 0) b USING (l_orderkey, l_linenumber)")
def diff_blocks(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("p", F.col("l_linenumber"))
    new = rows.where("l_partkey % 7 <> 0").withColumns({"p": F.col("p") + 1, "l_quantity": F.when(F.col("l_suppkey") % 4 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))})
    return diff.blocks(rows.where("l_partkey % 5 <> 0"), new, ["l_orderkey", "l_linenumber"], "p", "l_quantity")


@query("SELECT p_partkey, len(issues) AS n_issues FROM (SELECT p_partkey, list_filter([CASE WHEN NOT p_size >= 10 THEN 'size' END, CASE WHEN NOT regexp_full_match(p_brand, 'Brand#[1-3]+') THEN 'brand' END, CASE WHEN NOT p_retailprice < 1500 THEN 'price' END], lambda x: x IS NOT NULL) AS issues FROM part)")
def validation_issues(spark, sf):
    rules = [("p_size", F.col("p_size") >= 10, "too small"), ("p_brand", F.col("p_brand").rlike(r"^Brand#[1-3]+\z"), "format"), ("p_retailprice", F.col("p_retailprice") < 1500, "too dear")]
    return table(spark, sf, "part").select("p_partkey", F.size(scalars.issues(rules)).cast("long").alias("n_issues"))


@query("SELECT event_id, CASE WHEN event_id % 100 BETWEEN 11 AND 13 THEN event_id::VARCHAR || 'th' WHEN event_id % 10 = 1 THEN event_id::VARCHAR || 'st' WHEN event_id % 10 = 2 THEN event_id::VARCHAR || 'nd' WHEN event_id % 10 = 3 THEN event_id::VARCHAR || 'rd' ELSE event_id::VARCHAR || 'th' END AS ordinal, least(5.0 * pow(2, event_id % 10), 600.0) AS wait, sha256(event_type) AS digest, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def scalar_functions(spark, sf):
    e = F.col("event_id")
    wait = scalars.backoff(e % 10 + 1, 5.0, 600.0)
    return table(spark, sf, "events").select("event_id", scalars.ordinal(e).alias("ordinal"), wait.alias("wait"), F.sha2("event_type", 256).alias("digest"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))


_REVENUE = "SELECT n_name AS nation, year(o_orderdate)::BIGINT AS year, sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT))::BIGINT AS cents, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) > 5"


@query(_REVENUE)
def sql_aggregate(spark, sf):
    for name in ("lineitem", "orders", "customer", "nation"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return execute(spark, _REVENUE.replace("::BIGINT", "")).select("nation", F.col("year").cast("long").alias("year"), "cents", "orders")


@query("SELECT o_orderkey, rank() OVER w AS rnk, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def sql_windows(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return execute(spark, ORACLES["sql_windows"])


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def sql_set_operations(spark, sf):
    for name in ("customer", "supplier", "nation"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return execute_many(spark, [(ORACLES["sql_set_operations"],)])[0]


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def sql_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
