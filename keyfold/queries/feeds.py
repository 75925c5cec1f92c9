"""Reads, searches, append outcomes, extraction and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import typed
from keyfold.operators import pipes, reads, subscriptions
from keyfold.plans.declarations import Miss
from keyfold.sources.feeds import FEED_SQL, events_feed, stored_feed
from keyfold.sources.shared import table

WITH = "WITH " + FEED_SQL
FROM_NS, TO_NS = 1704153600000000000, 1705017600000000000  # 2024-01-02 to 2024-01-12


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_feed(spark, sf_dir)


def feed_read_after(spark, sf_dir):
    return reads.read_after(_feed(spark, sf_dir), 500, 300).select("pos", "event_id", "key", "ingest_time_ns")


def feed_read_event_time(spark, sf_dir):
    return reads.read_from_event_time(_feed(spark, sf_dir), TO_NS, 400).select("pos", "event_id", "event_time_ns")


def feed_tail(spark, sf_dir):
    return reads.tail(_feed(spark, sf_dir), 200).select("pos", "event_id", "key")


def feed_read_bytes(spark, sf_dir):
    return reads.read_within_bytes(_feed(spark, sf_dir), 100, 500, 20_000).select("pos", "event_id", "used_bytes")


def feed_search(spark, sf_dir):
    found = reads.search(_feed(spark, sf_dir), from_ns=FROM_NS, to_ns=TO_NS, metadata_key="tenant", metadata_value=b"click")
    return found.select("pos", "event_id", "event_time_ns")


def feed_search_key(spark, sf_dir):
    return reads.search(_feed(spark, sf_dir), key="k-7").select("pos", "event_id")


def feed_search_progress(spark, sf_dir):
    """A search from position 200 that goes through 5,000 records."""
    return reads.search_progress(_feed(spark, sf_dir), 200, 5000)


def feed_new_only(spark, sf_dir):
    return reads.new_only(_feed(spark, sf_dir))


def feed_lookup(spark, sf_dir):
    """The records at the positions of every tenth customer's number."""
    wanted = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 5 + 1).alias("pos")).where("pos <= 700")
    return reads.lookup(_feed(spark, sf_dir), wanted).select("pos", "event_id", "key")


def _attempts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("producer"), "event_type", "props")
    first = events.select("event_id", "producer", "props", (F.col("event_id") * 4).alias("attempt_no"))
    retried = events.where("event_id % 5 = 0").select("event_id", "producer", "props", (F.col("event_id") * 4 + 1).alias("attempt_no"))
    changed = events.where("event_id % 7 = 0").select("event_id", "producer", F.concat("props", F.lit("!")).alias("props"), (F.col("event_id") * 4 + 2).alias("attempt_no"))
    return first.unionByName(retried).unionByName(changed).withColumn("digest", F.sha2("props", 256))


ATTEMPTS = """attempts AS (
  SELECT event_id, producer, attempt_no, sha256(props) AS digest FROM (
    SELECT event_id, user_id % 10 AS producer, props, event_id * 4 AS attempt_no FROM events
    UNION ALL SELECT event_id, user_id % 10, props, event_id * 4 + 1 FROM events WHERE event_id % 5 = 0
    UNION ALL SELECT event_id, user_id % 10, props || '!', event_id * 4 + 2 FROM events WHERE event_id % 7 = 0))"""


def feed_dedup(spark, sf_dir):
    return reads.append_outcomes(_attempts(spark, sf_dir), ["producer", "event_id"], "attempt_no", "digest").select("producer", "event_id", "attempt_no", "outcome", "accepted_at")


def feed_request_dedup(spark, sf_dir):
    """Retries by (session, request id); attempts without a key are refused."""
    d = _attempts(spark, sf_dir).select(
        (F.col("producer") % 3).alias("session"), F.concat(F.lit("r"), F.expr("event_id div 2")).alias("request_id"), "attempt_no", "digest",
        F.when(F.col("attempt_no") % 9 != 0, F.concat(F.lit("k"), "producer")).otherwise("").alias("key"),
    )
    return reads.append_outcomes(d, ["session", "request_id"], "attempt_no", "digest", "key").select("session", "request_id", "attempt_no", "outcome", "accepted_at")


def feed_sequence_classify(spark, sf_dir):
    d = _attempts(spark, sf_dir).withColumn("sequence", F.expr("event_id div 10"))
    return reads.classify_sequences(d, "producer", "attempt_no", "sequence").select("producer", "attempt_no", "sequence", "kind")


def feed_stats(spark, sf_dir):
    return reads.feed_stats(events_feed(spark, sf_dir), ["event_type"])


def extract_typed(spark, sf_dir):
    d = events_feed(spark, sf_dir)
    for name, path in (("customer", "customer"), ("cents", "cents"), ("tag", "tag"), ("k", "nested.k"), ("missing", "nested.none"), ("object", "nested")):
        v = typed.json_value(F.col("payload"), path)
        d = d.withColumns({f"{name}_tag": v["tag"].cast("int"), name: typed.shown(v)})
    return d.select("event_id", typed.is_json(F.col("payload")).alias("json"), *[c for n in ("customer", "cents", "tag", "k", "missing", "object") for c in (f"{n}_tag", n)])


def extract_bytes(spark, sf_dir):
    """Keys and metadata as typed bytes; a record without the entry gives null."""
    d = events_feed(spark, sf_dir)
    for name, value in (("record_key", F.col("key").cast("binary")), ("tenant", F.try_element_at("metadata", F.lit("tenant"))), ("absent", F.try_element_at("metadata", F.lit("none")))):
        v = typed.bytes_(value)
        d = d.withColumns({f"{name}_tag": v["tag"].cast("int"), name: typed.shown(v)})
    return d.select("event_id", *[c for n in ("record_key", "tenant", "absent") for c in (f"{n}_tag", n)])


def scalar_functions(spark, sf_dir):
    """Sums and products at the ends of their range, and identities that follow from their parts."""
    e, big = F.col("event_id"), F.lit(2**63 - 1)
    return table(spark, sf_dir, "events").select(
        "event_id",
        typed.saturating_add(F.when(e % 3 == 0, big - 5).otherwise(e), e).alias("added"),
        typed.saturating_add(F.when(e % 3 == 0, -big).otherwise(-e), -e).alias("taken"),
        typed.saturating_multiply(F.when(e % 5 == 0, big).otherwise(e), F.when(e % 2 == 0, -e).otherwise(e)).alias("product"),
        typed.derived_id("copy", F.col("event_type"), F.col("user_id")).alias("derived"),
    )


def lookup_keys(spark, sf_dir):
    """What a value of each type looks a store row up by."""
    d = events_feed(spark, sf_dir)
    return d.select("event_id", F.base64(typed.key_bytes(typed.json_value(F.col("payload"), "tag"))).alias("lookup"), F.base64(typed.key_bytes(typed.json_value(F.col("payload"), "customer"))).alias("customer"))


def key_tokens(spark, sf_dir):
    d = events_feed(spark, sf_dir).select("key").distinct()
    return d.select("key", typed.key_token(F.col("key")).alias("token"), typed.work_window(F.col("key")).alias("work_window"))


def _store(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("store_key"), F.col("c_name").alias("store_payload"), "c_nationkey"
    )


OUT = ["event_id", "matched", "enrich_payload", "enrich_seq"]


def pipe_forward(spark, sf_dir):
    return pipes.forward(events_feed(spark, sf_dir), F.col("event_type") == "purchase").select("event_id", "key", "event_time_ns")


def enrich_forward(spark, sf_dir):
    return pipes.enrich(events_feed(spark, sf_dir), _store(spark, sf_dir).drop("c_nationkey"), F.col("user_id").cast("string"), applied_sequence=7).select(OUT)


def enrich_drop(spark, sf_dir):
    return pipes.enrich(events_feed(spark, sf_dir), _store(spark, sf_dir).drop("c_nationkey"), F.col("user_id").cast("string"), Miss.DROP, 7).select(OUT)


def enrich_quarantine(spark, sf_dir):
    return pipes.enrich(events_feed(spark, sf_dir), _store(spark, sf_dir).drop("c_nationkey"), F.col("user_id").cast("string"), Miss.QUARANTINE, 7).select(*OUT, "quarantine")


def enrich_named(spark, sf_dir):
    by_nation = pipes.by_named_key(_store(spark, sf_dir), "c_nationkey")
    return pipes.enrich(events_feed(spark, sf_dir), by_nation, F.col("user_id") % 30).select("event_id", "matched", "enrich_payload")


def _metadata(spark, sf_dir, miss):
    feed = events_feed(spark, sf_dir)
    stale = F.create_map(F.lit("enrich.matched"), F.lit(b"old"), F.lit("trace"), F.col("event_id").cast("string").cast("binary"))
    feed = feed.withColumn("metadata", F.when(F.col("event_id") % 2 == 0, stale).otherwise(F.col("metadata")))
    d = pipes.enriched_records(feed, _store(spark, sf_dir).drop("c_nationkey"), F.col("user_id").cast("string"), miss, 7)
    names = {"matched": "enrich.matched", "seq": "enrich.seq", "enriched": "enrich.payload", "quarantined": "enrich.quarantine", "trace": "trace", "tenant": "tenant"}
    shown = [F.try_element_at("metadata", F.lit(v)).cast("string").alias(k) for k, v in names.items()]
    return d.select("event_id", "payload", "to_quarantine", *shown, F.size(F.map_keys("metadata")).alias("entries"))


def enrich_metadata(spark, sf_dir):
    return _metadata(spark, sf_dir, Miss.FORWARD)


def enrich_metadata_quarantine(spark, sf_dir):
    return _metadata(spark, sf_dir, Miss.QUARANTINE)


def domain_union(spark, sf_dir):
    events = events_feed(spark, sf_dir).select("event_id", "key", "ingest_time_ns")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.concat(F.lit("c-"), "o_custkey").alias("key"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ingest_time_ns")
    )
    both = subscriptions.union_of_feeds({"shop.events": events, "shop.orders": orders})
    return both.where(reads.matches_pattern(F.col("feed"), "shop.*")).groupBy("feed").agg(F.count(F.lit(1)).alias("records"), F.max("ingest_time_ns").alias("last_ns"))


ENRICH = """, s AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_name FROM customer WHERE c_mktsegment = 'BUILDING'),
e AS (SELECT event_id, s.k IS NOT NULL AS matched, nullif(c_name, '') AS enrich_payload, CASE WHEN s.k IS NULL THEN 0 ELSE 7 END::BIGINT AS enrich_seq
  FROM feed LEFT JOIN s ON CAST(user_id AS VARCHAR) = s.k)"""


def _shown(path: str, name: str) -> str:
    j = f"CASE WHEN json_valid(payload) THEN json_extract(payload, '{path}') END"
    kind = f"CASE WHEN json_valid(payload) THEN json_type(payload, '{path}') END"
    return (
        f"CASE {kind} WHEN 'BOOLEAN' THEN 1 WHEN 'UBIGINT' THEN 2 WHEN 'BIGINT' THEN 2 WHEN 'VARCHAR' THEN 4 ELSE 0 END::INT AS {name}_tag, "
        f"CASE WHEN {kind} IN ('BOOLEAN', 'UBIGINT', 'BIGINT', 'VARCHAR') THEN json_extract_string({j}, '$') END AS {name}"
    )


def _wire(quarantine: bool) -> str:
    """Enriched records by the wire form: own entries replaced, all others kept."""
    q = "NOT matched" if quarantine else "false"
    return f""", w AS (SELECT feed.event_id, payload, matched, {q} AS q, enrich_payload, enrich_seq, CASE WHEN feed.event_id % 2 = 0 THEN feed.event_id::VARCHAR END AS trace, CASE WHEN feed.event_id % 2 <> 0 THEN tenant END AS tenant FROM feed JOIN e ON e.event_id = feed.event_id)
      SELECT event_id, payload, q AS to_quarantine, matched::VARCHAR AS matched, enrich_seq::VARCHAR AS seq, enrich_payload AS enriched, CASE WHEN q THEN 'true' END AS quarantined, trace, tenant,
        (2 + q::INT + (enrich_payload IS NOT NULL)::INT + (trace IS NOT NULL)::INT + (tenant IS NOT NULL)::INT) AS entries FROM w"""


QUERIES = {f.__name__: f for f in (feed_read_after, feed_read_event_time, feed_tail, feed_read_bytes, feed_search, feed_search_key, feed_search_progress, feed_new_only, feed_lookup, feed_dedup, feed_request_dedup, feed_sequence_classify, feed_stats, extract_typed, extract_bytes, scalar_functions, lookup_keys, key_tokens, pipe_forward, enrich_forward, enrich_drop, enrich_quarantine, enrich_named, enrich_metadata, enrich_metadata_quarantine, domain_union)}
SQL = {
    "feed_read_after": f"{WITH} SELECT pos, event_id, key, ingest_time_ns FROM feed WHERE pos > 500 AND pos <= 800",
    "feed_read_event_time": f"{WITH} SELECT pos, event_id, event_time_ns FROM feed WHERE event_time_ns >= {TO_NS} ORDER BY pos LIMIT 400",
    "feed_tail": f"{WITH} SELECT pos, event_id, key FROM feed ORDER BY pos DESC LIMIT 200",
    "feed_read_bytes": f"{WITH} SELECT pos, event_id, used_bytes FROM (SELECT pos, event_id, (sum(strlen(payload)) OVER (ORDER BY pos))::BIGINT AS used_bytes FROM feed WHERE pos > 100 AND pos <= 600) WHERE used_bytes <= 20000",
    "feed_search": f"{WITH} SELECT pos, event_id, event_time_ns FROM feed WHERE pos <= 10000 AND event_time_ns BETWEEN {FROM_NS} AND {TO_NS} AND tenant = 'click'",
    "feed_search_key": f"{WITH} SELECT pos, event_id FROM feed WHERE pos <= 10000 AND key = 'k-7'",
    "feed_dedup": f"WITH {ATTEMPTS}, f AS (SELECT *, row_number() OVER w AS n, first_value(digest) OVER w AS d, first_value(attempt_no) OVER w AS accepted_at FROM attempts WINDOW w AS (PARTITION BY producer, event_id ORDER BY attempt_no)) SELECT producer, event_id, attempt_no, CASE WHEN n = 1 THEN 'accepted' WHEN digest = d THEN 'deduplicated' ELSE 'conflict' END AS outcome, accepted_at FROM f",
    "feed_sequence_classify": f"WITH {ATTEMPTS}, f AS (SELECT producer, attempt_no, event_id // 10 AS sequence, max(event_id // 10) OVER (PARTITION BY producer ORDER BY attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM attempts) SELECT producer, attempt_no, sequence, CASE WHEN sequence = coalesce(last + 1, 0) THEN 'next' WHEN sequence > coalesce(last + 1, 0) THEN 'gap' WHEN sequence = last THEN 'repeat' ELSE 'stale' END AS kind FROM f",
    "feed_stats": f"{WITH} SELECT event_type, count(*) AS records, sum(strlen(payload))::BIGINT AS bytes, min(ingest_time_ns) AS first_ingest_ns, max(ingest_time_ns) AS last_ingest_ns FROM feed GROUP BY event_type",
    "extract_typed": f"{WITH} SELECT event_id, json_valid(payload) AS json, " + ", ".join(_shown(p, n) for p, n in (("$.customer", "customer"), ("$.cents", "cents"), ("$.tag", "tag"), ("$.nested.k", "k"), ("$.nested.none", "missing"), ("$.nested", "object"))) + " FROM feed",
    "key_tokens": f"{WITH} SELECT DISTINCT key, substr(sha256(key), 1, 32) AS token, ('0x' || substr(sha256(key), 15, 2))::INT AS work_window FROM feed",
    "pipe_forward": f"{WITH} SELECT event_id, key, event_time_ns FROM feed WHERE event_type = 'purchase'",
    "enrich_forward": f"{WITH}{ENRICH} SELECT * FROM e",
    "enrich_drop": f"{WITH}{ENRICH} SELECT * FROM e WHERE matched",
    "enrich_quarantine": f"{WITH}{ENRICH} SELECT *, NOT matched AS quarantine FROM e",
    "enrich_named": f"{WITH}, s AS (SELECT c_nationkey AS k, arg_min(c_name, CAST(c_custkey AS VARCHAR)) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) SELECT event_id, s.k IS NOT NULL AS matched, nullif(n, '') AS enrich_payload FROM feed LEFT JOIN s ON user_id % 30 = s.k",
    "feed_search_progress": f"{WITH} SELECT count(*) FILTER (pos > 200 AND pos <= 5200) AS scanned, max(pos) <= 5200 AS exhausted, CASE WHEN max(pos) > 5200 THEN 5200::BIGINT END AS next_after FROM feed",
    "feed_new_only": f"{WITH} SELECT max(pos) AS after_pos FROM feed",
    "feed_lookup": f"{WITH} SELECT pos, event_id, key FROM feed WHERE pos IN (SELECT c_custkey * 5 + 1 FROM customer) AND pos <= 700",
    "feed_request_dedup": f"""WITH {ATTEMPTS}, a AS (SELECT producer % 3 AS session, 'r' || (event_id // 2) AS request_id, attempt_no, digest FROM attempts),
      f AS (SELECT *, row_number() OVER w AS n, first_value(digest) OVER w AS d, first_value(attempt_no) OVER w AS accepted_at FROM a WHERE attempt_no % 9 <> 0 WINDOW w AS (PARTITION BY session, request_id ORDER BY attempt_no))
      SELECT session, request_id, attempt_no, CASE WHEN n = 1 THEN 'accepted' WHEN digest = d THEN 'deduplicated' ELSE 'conflict' END AS outcome, accepted_at FROM f
      UNION ALL SELECT session, request_id, attempt_no, 'refused', NULL FROM a WHERE attempt_no % 9 = 0""",
    "extract_bytes": f"{WITH} SELECT event_id, 3 AS record_key_tag, base64(encode(key)) AS record_key, CASE WHEN tenant IS NULL THEN 0 ELSE 3 END AS tenant_tag, base64(encode(tenant)) AS tenant, 0 AS absent_tag, NULL::VARCHAR AS absent FROM feed",
    "scalar_functions": """WITH e AS (SELECT event_id, event_type, user_id, CASE WHEN event_id % 3 = 0 THEN 9223372036854775802 ELSE event_id END::HUGEINT AS a, CASE WHEN event_id % 3 = 0 THEN -9223372036854775807 ELSE -event_id END::HUGEINT AS b,
        CASE WHEN event_id % 5 = 0 THEN 9223372036854775807 ELSE event_id END::HUGEINT * CASE WHEN event_id % 2 = 0 THEN -event_id ELSE event_id END AS p,
        sha256('copy|' || strlen(event_type) || ':' || event_type || strlen(user_id::VARCHAR) || ':' || user_id) AS h FROM events)
      SELECT event_id, least(a + event_id, 9223372036854775807)::BIGINT AS added, greatest(b - event_id, -9223372036854775808)::BIGINT AS taken, greatest(least(p, 9223372036854775807), -9223372036854775808)::BIGINT AS product,
        substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS derived FROM e""",
    "lookup_keys": f"{WITH} SELECT event_id, CASE WHEN json_valid(payload) THEN base64(encode(json_extract_string(payload, '$.tag'))) END AS lookup, CASE WHEN json_valid(payload) THEN base64(encode(json_extract_string(payload, '$.customer'))) END AS customer FROM feed",
    "enrich_metadata": f"{WITH}{ENRICH}{_wire(False)}",
    "enrich_metadata_quarantine": f"{WITH}{ENRICH}{_wire(True)}",
    "domain_union": f"{WITH} SELECT 'shop.events' AS feed, count(*) AS records, max(ingest_time_ns) AS last_ns FROM feed UNION ALL SELECT 'shop.orders', count(*), max(epoch_us(o_orderdate) * 1000) FROM orders",
}
