"""Registered queries of writes, the sync feed, document logs, keyed state and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import geo, scalars
from quern.operators import diff, doclog, keyed, relations, sync, writes
from quern.queries import query
from quern.sources import migrations
from quern.sources.tables import table

_MS = "SELECT *, epoch_us(ts) // 1000 AS ms FROM events"


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).withColumns({"created_at": F.lit(10).cast("long"), "updated_at": F.lit(10).cast("long")})


_ORDERS = "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, 10::BIGINT AS created_at, 10::BIGINT AS updated_at FROM orders"


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_get(spark, sf):
    return writes.get(table(spark, sf, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"SELECT id, status, CASE WHEN id % 3 = 0 THEN 99 ELSE created_at END::BIGINT AS created_at FROM ({_ORDERS})")
def create_rows(spark, sf):
    rows = _orders(spark, sf)
    return writes.created(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0").drop("created_at", "updated_at"), "id", F.lit(99).cast("long")).select("id", "status", "created_at")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment, c_nationkey AS nation, c_acctbal AS bal, CASE WHEN c_custkey % 5 = 0 AND c_mktsegment <> 'NEW' THEN 20 ELSE 10 END::BIGINT AS updated_at FROM customer")
def patch_deep(spark, sf):
    """Only the segment inside a struct is patched; a patch that repeats what stands (every third) changes no stamp."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("place"), F.col("c_acctbal").alias("bal"), F.lit(10).cast("long").alias("updated_at"))
    new = F.when(F.col("id") % 5 == 0, F.lit("NEW")).otherwise(F.col("place.segment"))
    patch = rows.where("id % 5 = 0 or id % 3 = 0").select("id", F.struct(new.alias("segment")).alias("place"), F.lit(None).cast("double").alias("bal"))
    return writes.patched(rows, patch, "id", F.lit(20).cast("long")).select("id", "place.segment", "place.nation", "bal", "updated_at")


@query(f"SELECT id, NULL::BIGINT AS deleted_at, status FROM ({_ORDERS}) WHERE id % 7 <> 0 UNION ALL SELECT id, 30, NULL FROM ({_ORDERS}) WHERE id % 7 = 0")
def delete_tombstones(spark, sf):
    rows = _orders(spark, sf)
    left, gone = writes.deleted(rows, rows.where("id % 7 = 0"), "id", F.lit(30).cast("long"))
    return left.select("id", F.lit(None).cast("long").alias("deleted_at"), "status").unionByName(gone.withColumn("status", F.lit(None).cast("string")))


@query(f"SELECT id, CASE WHEN id % 100 = 1 THEN 'Z' ELSE status END AS status, CASE WHEN id % 100 = 1 OR id >= 1000000 THEN 50 ELSE updated_at END::BIGINT AS updated_at FROM (SELECT * FROM ({_ORDERS}) UNION ALL SELECT id + 1000000, 'N', price, 50, 50 FROM ({_ORDERS}) WHERE id % 50 = 0) WHERE id % 100 <> 2 AND NOT (id % 100 = 1 AND status = 'Z')")
def transaction_ops(spark, sf):
    """Shares of a whole table are created, changed and deleted; the cap of a single request does not hold for it."""
    rows = _orders(spark, sf)
    new = rows.where("id % 50 = 0").select((F.col("id") + 1_000_000).alias("id"), F.lit("N").alias("status"), "price")
    change = rows.where("id % 100 = 1").select("id", F.lit("Z").alias("status"))
    out, _ = writes.transaction(rows, [("create", new), ("update", change), ("delete", rows.where("id % 100 = 2"))], "id", F.lit(50).cast("long"), most=None)
    return out.select("id", "status", "updated_at")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'none' WHEN event_id % 3 = 1 THEN NULL ELSE 'set' END AS m, json_extract(props, '$.k')::BIGINT AS k FROM events")
def defaults_json(spark, sf):
    """An absent key gets its default; an explicit null stays null."""
    extra = F.when(F.col("event_id") % 3 == 0, "}").when(F.col("event_id") % 3 == 1, ', "m": null}').otherwise(', "m": "set"}')
    raw = table(spark, sf, "events").select("event_id", F.concat(F.rtrim(F.col("props"), F.lit("}")), extra).alias("doc"))
    return writes.defaults(raw, "doc", "k long, m string", {"m": F.lit("none")})


@query("SELECT event_id, CAST(value AS DECIMAL(28,10)) % CAST(0.05 AS DECIMAL(28,10)) = 0 AS on_step FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
def step_check(spark, sf):
    return table(spark, sf, "events").where("value is not null").select("event_id", scalars.on_step(F.col("value"), "0.05").alias("on_step"))


@query("SELECT event_id, (event_id % 15) BETWEEN 1 AND 12 AND (event_id % 35) BETWEEN 1 AND 31 AS is_date, event_id % 30 < 24 AND event_id % 70 < 60 AS is_time, event_id % 300 < 256 AS is_ipv4, event_id % 4 IN (0, 1) AS is_color, event_id % 3 > 0 AS is_email, event_id % 9 BETWEEN 1 AND 8 AS is_uuid, event_id % 2 = 0 AS is_ipv6 FROM events")
def string_formats(spark, sf):
    e = F.col("event_id")
    two = lambda n: F.lpad((e % n).cast("string"), 2, "0")
    ok = {
        "date": F.concat(F.lit("2020-"), two(15), F.lit("-"), two(35)),
        "time": F.concat(two(30), F.lit(":"), two(70)),
        "ipv4": F.concat((e % 300).cast("string"), F.lit(".0.10.255")),
        "color": F.element_at(F.array(*map(F.lit, ("#abc", "#A0b1C2", "#ab", "abc"))), (e % 4 + 1).cast("int")),
        "email": F.element_at(F.array(*map(F.lit, ("a..b@c.de", "a.b@c.de", "o'k+1@x-y.org"))), (e % 3 + 1).cast("int")),
        "uuid": F.concat(F.lit("12345678-1234-"), (e % 9).cast("string"), F.lit("234-8234-123456789abc")),
        "ipv6": F.when(e % 2 == 0, "fe80::1:2").otherwise("1::2::3"),
    }
    return table(spark, sf, "events").select("event_id", *(scalars.of_format(text, name).alias(f"is_{name}") for name, text in ok.items()))


@query("SELECT event_id, TRY_CAST(trim(['12.5', ' 7 ', 'x', ''][event_id % 4 + 1]) AS DOUBLE) AS number, [true, false, NULL, true][event_id % 4 + 1] AS flag, 'ab c' AS word FROM events")
def coerce_values(spark, sf):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", scalars.coerced(pick("12.5", " 7 ", "x", ""), "number").alias("number"), scalars.coerced(pick("Yes", "0", "maybe", "TRUE "), "boolean").alias("flag"), scalars.transformed(F.lit(" Ab C\n"), ["trim", "lowercase"]).alias("word"))


@query("SELECT min(s) AS oldest, max(s) AS newest FROM (SELECT nullif((epoch_us(ts) // 1000) * (event_id % 2), 0)::BIGINT AS s FROM events UNION ALL SELECT epoch_ms(o_orderdate)::BIGINT FROM orders)")
def sync_bounds(spark, sf):
    events = _events(spark, sf).select((F.col("ms") * (F.col("event_id") % 2)).alias("s"))
    orders = table(spark, sf, "orders").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("s"))
    return sync.bounds({"events": (events, "s"), "orders": (orders, "s"), "none": (orders.limit(0), "s")})


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3 AND (SELECT count(*) FROM orders) > 50")
def sync_deferred(spark, sf):
    """Withheld by the low ceiling, let through by the high one."""
    rows = table(spark, sf, "orders")
    page = rows.where("o_orderkey % 10 = 3").select("o_orderkey")
    return sync.deferred(page, rows, 50).union(sync.deferred(page, rows, 10**9))


@query("SELECT id, stamp FROM (SELECT *, row_number() OVER (ORDER BY stamp, id) AS rn, count(*) OVER () AS n FROM (SELECT o_orderkey AS id, o_custkey AS stamp FROM orders)) WHERE n <= 1000 OR rn > n // 2")
def tombstone_cap(spark, sf):
    return sync.capped(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("stamp")), "id", "stamp", 1000)[0]


@query(f"SELECT event_id FROM ({_MS}) WHERE (event_type <> 'click' OR ms >= 1706000000000 - 2 * 86400000) AND (event_type <> 'error' OR ms >= 1706000000000 - 10 * 86400000)")
def retention_sweep(spark, sf):
    return sync.retained(_events(spark, sf), "event_type", "ms", {"click": 2, "error": 10, "view": 0}, 1_706_000_000_000).select("event_id")


@query("SELECT doc_id, source, text IS NOT NULL AS omitted, false AS has_vector FROM documents")
def history_payload(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "text", F.array(F.lit(1.0)).alias("vector"))
    raw = rows.select("doc_id", sync.payload(rows, ("text",), ("vector",)).alias("raw"))
    omitted = F.coalesce(F.get_json_object("raw", "$.text.__blob_omitted") == "true", F.lit(False))
    return raw.select("doc_id", F.get_json_object("raw", "$.source").alias("source"), omitted.alias("omitted"), F.get_json_object("raw", "$.vector").isNotNull().alias("has_vector"))


@query("SELECT event_id AS entity_id, event_type AS field, 'u5' AS actor FROM events WHERE user_id = 5")
def operation_changes(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("entity_id"), F.col("event_type").alias("field"), F.col("ts").alias("created_at"), "user_id")
    log = sync.scoped(rows.where("user_id = 5"), "u5", "op5").unionByName(sync.scoped(rows.where("user_id = 6"), "u6", "op6"))
    return sync.operation(log, "op5").select("entity_id", "field", "actor")


@query("SELECT o_orderkey AS id, 'f' || o_custkey AS file_key FROM orders WHERE o_orderkey % 4 IN (0, 1) AND o_custkey IS NOT NULL")
def file_gc(spark, sf):
    before = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), "o_custkey").alias("key"))
    after = before.where("id % 4 <> 0").withColumn("key", F.when(F.col("id") % 4 == 1, "other").otherwise(F.col("key")))
    return sync.released(before, after, "id", "key")


_LOG = "SELECT user_id AS doc, event_id AS seq, 'f' || event_id AS frontier, length(event_type) * 10 AS bytes, epoch_us(ts) // 1000 AS ms FROM events"


def _log(spark, sf):
    return _events(spark, sf).select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("frontier"), (F.length("event_type") * 10).alias("bytes"), "ms")


@query(f"SELECT doc, seq FROM ({_LOG}) WHERE seq > 100 AND seq <= 5000 AND doc < 20")
def doc_updates(spark, sf):
    return doclog.updates(_log(spark, sf).where("doc < 20"), "doc", "seq", 100, 5000).select("doc", "seq")


_FLOOR = f"SELECT doc, min(seq) AS floor FROM ({_LOG}) WHERE 1706000000000 - ms <= 864000000 AND seq % 3 = 0 GROUP BY doc"


def _floors(spark, sf):
    return doclog.floor(_log(spark, sf).where("seq % 3 = 0"), "doc", "seq", "ms", 1_706_000_000_000, 864_000_000)


@query(_FLOOR)
def peer_floor(spark, sf):
    return _floors(spark, sf)


@query(f"SELECT doc, frontier, CASE WHEN seq % 5 = 0 THEN -seq WHEN seq % 2 = 0 THEN seq END AS seq FROM ({_LOG})")
def frontier_seq(spark, sf):
    """A checkpoint's place comes first, then the log's; frontiers that neither has are unknown."""
    log = _log(spark, sf)
    marks = log.where("seq % 5 = 0").select("doc", "frontier", (-F.col("seq")).alias("seq"))
    return doclog.places(log.select("doc", "frontier"), log.where("seq % 2 = 0"), marks, "doc")


@query(f"WITH l AS ({_LOG}), f AS ({_FLOOR}), s AS (SELECT doc, seq AS covers_seq, bytes * 3 AS bytes, seq % 2 = 0 AS pinned FROM l WHERE seq % 10 = 1 OR seq % 10 = 4), h AS (SELECT doc, max(seq) AS head, sum(bytes) AS bytes FROM l GROUP BY doc), p AS (SELECT h.*, least(head, coalesce(floor, head)) AS boundary FROM h LEFT JOIN f USING (doc)), r AS (SELECT p.*, (SELECT count(*) FROM l WHERE l.doc = p.doc AND seq <= boundary) AS discarded, (SELECT coalesce(sum(bytes), 0) FROM l WHERE l.doc = p.doc AND seq <= boundary) AS a, (SELECT coalesce(sum(bytes), 0) FROM s WHERE s.doc = p.doc AND NOT pinned AND covers_seq < boundary) AS b, (SELECT count(*) FROM s WHERE s.doc = p.doc AND NOT pinned AND covers_seq < boundary) AS dropped_snapshots, (SELECT arg_max(bytes, covers_seq) FROM s WHERE s.doc = p.doc) AS last FROM p) SELECT doc, boundary, discarded, (a + b)::BIGINT AS freed, dropped_snapshots, CASE WHEN doc % 11 = 0 THEN 'retention_forever' WHEN bytes < 500 THEN 'below_threshold' WHEN discarded = 0 THEN 'peer_floor' WHEN coalesce(last, bytes) > a + b THEN 'would_grow' END AS skipped FROM r")
def compaction_plan(spark, sf):
    log = _log(spark, sf)
    shots = log.where("seq % 10 in (1, 4)").select("doc", F.col("seq").alias("covers_seq"), (F.col("bytes") * 3).alias("bytes"), (F.col("seq") % 2 == 0).alias("pinned"))
    kept = log.where("doc % 11 = 0").select("doc").distinct()
    return doclog.compaction(log, _floors(spark, sf), shots, "doc", 500, kept)


@query(f"SELECT event_id FROM ({_MS}) WHERE 1706000000000 - ms <= 604800000 AND user_id % 3 <> 0")
def presence_live(spark, sf):
    """Presences of the last week, less those of connections that ended."""
    rows = keyed.live(_events(spark, sf), "ms", 1_706_000_000_000, 604_800_000)
    return keyed.without_owner(rows, "user_id", _events(spark, sf).where("user_id % 3 = 0")).select("event_id")


@query(f"WITH RECURSIVE e AS (SELECT user_id, event_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM ({_MS})), r AS (SELECT user_id, event_id, n, ms AS refilled, 3::BIGINT - 1 AS c FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, r.refilled + ((e.ms - r.refilled) // 7200000) * 7200000, least(3, r.c + (e.ms - r.refilled) // 7200000) - 1 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT event_id, c AS left, c >= 0 AS allowed FROM r")
def websocket_bucket(spark, sf):
    return keyed.counted_bucket(_events(spark, sf), "user_id", "ms", "event_id", 3, 7_200_000).select("event_id", "left", "allowed")


_DJB2 = "list_reduce(list_transform(string_split(event_type, ''), lambda x: ord(x)::BIGINT), lambda h, c: (h * 33 + c) % 4294967296, 5381::BIGINT)"


@query(f"SELECT event_id, lower(to_base({_DJB2}, 36)) || '_' || length(event_type) AS digest FROM events")
def djb2_digest(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.djb2(F.col("event_type")).alias("digest"))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 1 OR event_id % 2 = 1")
def embed_stale(spark, sf):
    """Stored digests are missing (0 mod 3), of another text (odd, or 2 mod 3), or right."""
    rows = table(spark, sf, "events").select("event_id", F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    old = rows.where("event_id % 3 <> 0").select("event_id", scalars.djb2(F.when((F.col("event_id") % 3 == 1) & (F.col("event_id") % 2 == 0), F.col("text")).otherwise(F.lit("old"))).alias("digest"))
    return keyed.stale(rows, old, "event_id", "text", scalars.djb2(F.col("text")))


@query("SELECT event_id, CASE WHEN a >= 8 THEN 'drop' WHEN a >= 3 THEN 'solo' ELSE 'retry' END AS next, CASE WHEN a < 8 THEN least(5.0 * pow(2, a - 1), 600.0) END AS wait FROM (SELECT event_id, event_id % 10 + 1 AS a FROM events)")
def retry_plan(spark, sf):
    return keyed.retries(table(spark, sf, "events").select("event_id", (F.col("event_id") % 10 + 1).alias("a")), "a", 5.0, 600.0).select("event_id", "next", "wait")


@query(f"SELECT doc, user_id, session, min(ms) AS started, max(ms) AS ended, count(*) AS events FROM (SELECT *, sum(o) OVER (PARTITION BY doc ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR ms - lag(ms) OVER w >= 3600000 OR user_id IS DISTINCT FROM lag(user_id) OVER w OR lag(event_type) OVER w = 'error' THEN 1 ELSE 0 END AS o FROM (SELECT *, user_id // 5 AS doc FROM ({_MS})) WINDOW w AS (PARTITION BY doc ORDER BY ms, event_id))) GROUP BY ALL")
def document_sessions(spark, sf):
    """Sessions of a document: another actor in between, a long gap, or a checkpoint ends them."""
    rows = _events(spark, sf).withColumns({"doc": F.expr("user_id div 5"), "mark": F.col("event_type") == "error"})
    return keyed.sessions(rows, "doc", "ms", "event_id", 3_600_000, "user_id", "mark")


_SIGN = "list_reduce(list_transform(string_split(c_name, ''), lambda x: (1::BIGINT << (xor(ord(x), ord(x) >> 5) & 31))), lambda a, b: a | b)"


@query(f"SELECT c_custkey, {_SIGN} AS signature, bit_count({_SIGN})::BIGINT AS bits FROM customer")
def character_signatures(spark, sf):
    s = scalars.character_signature(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", s.alias("signature"), F.bit_count(s).cast("long").alias("bits"))


_B62 = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'"


@query(f"SELECT event_id, array_to_string(list_transform(range(7, -1, -1), lambda k: substring({_B62}, ((ms // (pow(62, k)::BIGINT)) % 62 + 1)::INT, 1)), '') AS prefix FROM ({_MS})")
def time_ids(spark, sf):
    return _events(spark, sf).select("event_id", scalars.time_prefix(F.col("ms")).alias("prefix"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages WHERE url IS NOT NULL AND regexp_matches(url, '^[a-z]+://[^/?# ]+([/?#][^ ]*)?$')")
def url_parse(spark, sf):
    rows = table(spark, sf, "pages").where("url is not null and url rlike '^[a-z]+://[^/?# ]+([/?#][^ ]*)?$'").withColumn("u", scalars.url_parts(F.col("url")))
    return rows.select("page_id", "u.protocol", "u.host")


@query("SELECT c_custkey, '#' || lpad(lower(to_hex(255 - c_custkey % 256)), 2, '0') || 'ff00' AS inverted, CASE WHEN c_custkey % 2 = 0 THEN 17 ELSE 0 END AS red FROM customer")
def colors(spark, sf):
    k = F.col("c_custkey")
    color = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(k % 256)), 2, "0"), F.lit("00ff"))
    return table(spark, sf, "customer").select("c_custkey", scalars.inverted(color).alias("inverted"), F.coalesce(scalars.rgb(F.when(k % 2 == 0, "#123").otherwise("#1g3"))[0], F.lit(0)).alias("red"))


@query("SELECT c_custkey, c_name AS back FROM customer")
def base64url_round_trip(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalars.unbase64url(scalars.base64url(F.encode("c_name", "UTF-8"))).cast("string").alias("back"))


_POINT = "SELECT c_custkey, (c_custkey * 3701 % 18000) / 100.0 - 90 AS lat, (c_custkey * 9103 % 36000) / 100.0 - 180 AS lon FROM customer"


@query(f"SELECT c_custkey, lat BETWEEN -20 AND 50 AND (lon >= 150 OR lon <= -100) AS inside, round(degrees(asin(sin(radians(lat)) * cos(0.1) + cos(radians(lat)) * sin(0.1) * cos(radians(60)))), 6) AS to_lat FROM ({_POINT})")
def geo_box(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", (k * 3701 % 18000 / 100.0 - 90).alias("lat"), (k * 9103 % 36000 / 100.0 - 180).alias("lon"))
    to = geo.destination(F.col("lat"), F.col("lon"), F.lit(60.0), F.lit(637100.0))
    return rows.select("c_custkey", geo.inside_box(F.col("lat"), F.col("lon"), -20, 150, 50, -100).alias("inside"), F.round(to["lat"], 6).alias("to_lat"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN -1 ELSE o_custkey END AS o_custkey FROM orders")
def enforce_default(spark, sf):
    gone = table(spark, sf, "customer").where("c_custkey % 9 = 0")
    return relations.enforce(table(spark, sf, "orders"), "o_custkey", gone, "c_custkey", "set_default", -1).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 20 = 0)")
def anti_fk_some(spark, sf):
    """Customers without any of every twentieth order (a cascade that leaves rows)."""
    return relations.enforce(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders").where("o_orderkey % 20 = 0"), "o_custkey", "cascade").select("c_custkey")


@query("SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_id <= a.event_id AND b.event_id % 17 = 0) THEN 'waiting' WHEN EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_id < a.event_id AND b.event_id % 13 = 0) THEN 'dependency_failed' WHEN event_id % 13 = 0 THEN 'rejected' ELSE 'sent' END AS status FROM events a")
def outbox_retry(spark, sf):
    e = F.col("event_id")
    return keyed.outbox(table(spark, sf, "events"), "user_id", "event_id", e % 13 == 0, e % 17 == 0).select("event_id", "status")


@query("SELECT n AS user_id, coalesce(tabs, 0) AS tabs, coalesce(here, false) AS here, image FROM (SELECT DISTINCT user_id AS n FROM events) LEFT JOIN (SELECT user_id, count(*) AS tabs, bool_or(value > 90) AS here, arg_min('i' || event_id, event_id) FILTER (event_type = 'view') AS image FROM events WHERE event_id % 40 = 0 OR event_id % 41 = 0 GROUP BY user_id) ON user_id = n")
def roster_sessions(spark, sf):
    """Presences with the first image of each user; users with a session and no presence stand with none."""
    events = table(spark, sf, "events")
    here = events.where("event_id % 40 = 0 or event_id % 41 = 0")
    image = F.when(F.col("event_type") == "view", F.concat(F.lit("i"), F.col("event_id").cast("string")))
    out = keyed.roster(here, "user_id", F.length("event_type"), F.coalesce(F.col("value") > 90, F.lit(False)), image, "event_id", events)
    return out.select("user_id", "tabs", "here", "image")


@query("SELECT o_orderkey, o_totalprice::BIGINT AS cents, upper(o_orderstatus) AS state FROM (SELECT o_orderkey, round(o_totalprice * 100) AS o_totalprice, o_orderstatus FROM orders)")
def migrate_columns(spark, sf):
    steps = [
        migrations.Migration(2, "state", lambda t: {"orders": migrations.alter_column(t["orders"], "o_orderstatus", F.upper("o_orderstatus"), "state")}),
        migrations.Migration(1, "cents", lambda t: {"orders": migrations.alter_column(t["orders"], "o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long"), "cents")}),
        migrations.Migration(3, "narrow", lambda t: {"orders": t["orders"].select("o_orderkey", "cents", "state")}),
    ]
    return migrations.run({"orders": table(spark, sf, "orders")}, steps, migrations.Record())[0]["orders"]


@query("SELECT o_orderkey, c_name, n_name FROM orders RIGHT JOIN (SELECT * FROM customer WHERE c_custkey % 50 = 0) ON o_custkey = c_custkey FULL JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey UNION SELECT NULL, s_name, NULL FROM supplier WHERE s_suppkey IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT NULL, 'x', n_name FROM nation CROSS JOIN (SELECT 1 AS one)")
def sql_joins(spark, sf):
    from quern.queries import ORACLES
    from quern.sources.tables import execute_many

    for name in ("orders", "customer", "nation", "supplier"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return execute_many(spark, [(ORACLES["sql_joins"],)])[0]


@query("SELECT doc, k, CASE WHEN a IS NULL THEN 'inserted' WHEN b IS NULL THEN 'deleted' ELSE 'both' END AS side FROM (SELECT l_orderkey AS doc, l_linenumber AS k, CASE WHEN l_linenumber <> 2 THEN 1 END AS a, CASE WHEN l_linenumber <> 3 THEN 1 END AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_orderkey < 200)")
def diff_structured(spark, sf):
    """Blocks inserted, deleted and in both (moved or not); the second version turns the order round."""
    rows = table(spark, sf, "lineitem").where("l_orderkey < 200").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("k"), F.col("l_linenumber").cast("double").alias("at"), F.col("l_quantity").cast("string").alias("text"))
    rows = rows.groupBy("doc", "k", "at").agg(F.min("text").alias("text"))
    out = diff.structured(rows.where("k <> 2"), rows.where("k <> 3").withColumn("at", -F.col("at")), "doc", "k", "at", "text")
    return out.select("doc", "k", F.when(F.col("status").isin("inserted", "deleted"), F.col("status")).otherwise("both").alias("side"))
