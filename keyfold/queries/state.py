"""Indexes, stores and subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyfold.functions import typed
from keyfold.operators import indexes, stores, subscriptions
from keyfold.sources.feeds import FEED_SQL, events_feed, stored_feed
from keyfold.sources.shared import table

WITH = "WITH " + FEED_SQL
DAY_10 = 1704844800000000000  # 2024-01-10
FIELDS = ["kind", "tag"]


def _index(spark, sf_dir):
    feed = stored_feed(spark, sf_dir)
    return indexes.build(feed, {"kind": typed.text(F.col("event_type")), "tag": typed.json_value(F.col("payload"), "tag")})


def _rows(d):
    return d.select("key", "event_id", "event_type", F.col("tag")["tag"].cast("int").alias("tag_type"), typed.shown(F.col("tag")).alias("tag_value"))


def index_latest(spark, sf_dir):
    return _rows(_index(spark, sf_dir))


def index_exact(spark, sf_dir):
    return _rows(indexes.exact(_index(spark, sf_dir), {"kind": typed.text(F.lit("click")), "tag": typed.boolean(F.lit(True))}, FIELDS))


def index_exact_null(spark, sf_dir):
    """A null field is found by a null: also rows whose payload is no JSON."""
    return _rows(indexes.exact(_index(spark, sf_dir), {"kind": typed.text(F.lit("click")), "tag": typed.null()}, FIELDS))


def index_prefix(spark, sf_dir):
    return _rows(indexes.prefix(_index(spark, sf_dir), {"kind": typed.text(F.lit("click"))}, FIELDS, ("tag", "t")))


def index_range(spark, sf_dir):
    d = indexes.between(_index(spark, sf_dir), {"kind": typed.text(F.lit("click"))}, "tag", FIELDS, typed.i64(F.lit(2)), typed.text(F.lit("t3")), lower_open=True)
    return _rows(d)


def index_range_open(spark, sf_dir):
    """Without a lower bound, nulls and booleans come before integers up to 4."""
    return _rows(indexes.between(_index(spark, sf_dir), {"kind": typed.text(F.lit("click"))}, "tag", FIELDS, upper=typed.i64(F.lit(4)), upper_open=True))


def index_unique_first(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").alias("pos"), typed.i64(F.col("c_nationkey")).alias("nation")
    )
    return indexes.unique_claims(customers, "nation").select("key", typed.shown(F.col("nation")).alias("nation"), "conflicted")


def _postings(spark, sf_dir):
    return indexes.postings(_index(spark, sf_dir), {"by_kind": ["kind"], "by_tag": ["kind", "tag"]})


def index_resolve(spark, sf_dir):
    """Entries of both indexes with the rows that they stand for."""
    rows = _index(spark, sf_dir).select("key", "event_id")
    return indexes.resolved(_postings(spark, sf_dir), rows).select("index_name", "values", "key", "event_id")


def index_gaps(spark, sf_dir):
    """Entries left behind by rows that were deleted without them."""
    return indexes.posting_gaps(_postings(spark, sf_dir), _index(spark, sf_dir).where("event_type <> 'click'"))


def index_delete(spark, sf_dir):
    """Every asked key's outcome; most name no row."""
    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("k-"), F.col("c_custkey") * 3).alias("key"))
    left, outcomes = indexes.delete(_index(spark, sf_dir), keys)
    return outcomes.join(left.select("key", F.lit(True).alias("still")), "key", "left").select("key", "deleted", F.coalesce("still", F.lit(False)).alias("still"))


def index_retire(spark, sf_dir):
    return indexes.retire(_postings(spark, sf_dir), ["by_tag"])


def index_page_bytes(spark, sf_dir):
    """A page of rows in key order that keeps within 4 KiB of payload."""
    d = indexes.page(_index(spark, sf_dir), ["key"], F.octet_length("payload").cast("long"), 4096)
    return d.select("key", "event_id", "used_bytes")


def index_latest_posting(spark, sf_dir):
    """Which records still stand for their key."""
    feed = stored_feed(spark, sf_dir).select("key", "pos", "event_type")
    return indexes.latest_posting(feed, ["pos"]).select("pos", "key", "current")


def index_claims_fold(spark, sf_dir):
    """Unique values given up and taken again, folded by scope (no SQL; held against a plain fold in tests)."""
    d = stored_feed(spark, sf_dir).select((F.col("event_id") % 5).alias("scope"), "key", F.when(F.col("cents") % 11 != 0, F.col("cents") % 40).alias("value"), "pos")
    return indexes.claims_fold(d, "scope", "value")


def _journal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") == 1500, "clear").when(F.col("event_id") % 11 == 0, "delete").otherwise("put")
    return e.select(
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.concat(F.lit("k-"), F.col("event_id") % 997).alias("key"),
        F.col("event_type").alias("named"),
        F.round(F.col("value") * 100).cast("long").alias("amount"),
        F.concat(F.lit("m-"), F.expr("event_id div 2 * 2 + if(event_id % 6 = 1, 0, event_id % 2)")).alias("mutation_id"),
        F.sha2(F.concat(F.expr("cast(event_id % 3 as string)")), 256).alias("digest"),
    )


def store_fold(spark, sf_dir):
    return stores.fold(_journal(spark, sf_dir)).select("key", "seq", "named", "amount")


def store_get_by(spark, sf_dir):
    return stores.get_by(stores.fold(_journal(spark, sf_dir)), {"named": F.lit("view")}).select("key", "seq", "amount")


def store_range(spark, sf_dir):
    return stores.get_range(stores.fold(_journal(spark, sf_dir)), "amount", F.lit(1000), F.lit(4000)).select("key", "amount")


def store_iterate(spark, sf_dir):
    return stores.iterate(stores.fold(_journal(spark, sf_dir)), "k-3", 100).select("key", "seq", "next_key")


def store_iterate_pinned(spark, sf_dir):
    """A second page of the store as it was at sequence 900, whatever was put since."""
    then = stores.fold(stores.up_to(_journal(spark, sf_dir), 900))
    return stores.iterate(then, "k-5", 50, pinned=900).select("key", "seq", "next_key", "pinned_seq")


def store_mutations(spark, sf_dir):
    return stores.effective(_journal(spark, sf_dir)).select("seq", "mutation_id", "status")


def store_unique_fold(spark, sf_dir):
    """Unique values with releases, folded in order per scope (no SQL; held against a plain fold in tests)."""
    j = _journal(spark, sf_dir).withColumns({"scope": F.col("seq") % 5, "unique_value": F.col("amount") % 50})
    return stores.fold_unique(j, "scope").select("scope", "key", "seq", "unique_value")


def store_accumulate(spark, sf_dir):
    j = _journal(spark, sf_dir).select("named", F.lit(1).cast("long").alias("count"), F.col("amount").alias("sum"))
    return stores.accumulate(j.where("sum < 1000"), j.where("sum >= 1000"), ["named"])


def store_accumulate_claims(spark, sf_dir):
    """A key that names a value held by another loses its entry, not its sum."""
    j = _journal(spark, sf_dir).select("key", F.expr("cast(substring(key, 3) as int) % 300").alias("value"), F.lit(1).cast("long").alias("count"), F.col("amount").alias("sum"), "seq")
    return stores.accumulate_claiming(j, "key", "value", "seq")


def sub_starts(spark, sf_dir):
    """All four ways to start."""
    feed = stored_feed(spark, sf_dir)
    out = None
    for at, value in (("BEGINNING", None), ("NOW", None), ("TIMESTAMP", DAY_10), ("CURSOR", 321)):
        d = subscriptions.start(feed, at, value).select(F.lit(at).alias("start"), "after_pos")
        out = d if out is None else out.unionByName(d)
    return out


def sub_fetch(spark, sf_dir):
    """Deferred records of windows that are covered now come first, then what was not delivered yet."""
    feed = stored_feed(spark, sf_dir)
    covered = subscriptions.coverage(_leases(spark)).where("work_id in ('w-00', 'w-03', 'w-05')")
    delivered, deferred = feed.where("pos <= 800 and event_id % 3 <> 0").select("pos"), feed.where("pos <= 800 and event_id % 3 = 0").select("pos")
    return subscriptions.fetch(feed, covered, delivered, deferred, 300).select("pos", "event_id", "window", "redelivered")


def sub_seek_timestamp(spark, sf_dir):
    return subscriptions.start_at(stored_feed(spark, sf_dir), DAY_10)


def sub_delivery_delay(spark, sf_dir):
    d = subscriptions.delayed(stored_feed(spark, sf_dir), DAY_10, 3600 * 10**9)
    return d.select("pos", "event_id", "key")


def _leases(spark):
    rows = [(f"w-{i:02}", i % 5 != 4, [i * 3, i * 3 + 1] if i % 4 == 0 else []) for i in range(12)]
    return spark.createDataFrame(rows, "work_id string, live boolean, pinned array<int>")


def sub_coverage(spark, sf_dir):
    return subscriptions.coverage(_leases(spark))


def _divided(spark, sf_dir):
    covered = subscriptions.coverage(_leases(spark)).where("work_id in ('w-00', 'w-03')")
    return subscriptions.divided(stored_feed(spark, sf_dir), covered)


def sub_windowed_deliver(spark, sf_dir):
    return _divided(spark, sf_dir).where("deliver").select("pos", "event_id", "window")


def sub_deferred(spark, sf_dir):
    d = _divided(spark, sf_dir).where("not deliver")
    return d.groupBy("window").agg(F.count(F.lit(1)).alias("records"), F.min("pos").alias("first_pos"))


def sub_attempts(spark, sf_dir):
    work = events_feed(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("attempts"))
    return subscriptions.attempts_left(work, 10, "quarantine").select("key", "attempts", "action")


def frontier_split(spark, sf_dir):
    """Acknowledged is what was delivered before a key's last record: that one is still out."""
    feed = stored_feed(spark, sf_dir)
    last = feed.groupBy("key").agg(F.max("pos").alias("__last"))
    acked = feed.join(last, "key").where(F.col("pos") < F.col("__last"))
    return subscriptions.split_frontier(acked, "8" + "0" * 31)


def frontier_merge(spark, sf_dir):
    return subscriptions.merge_frontier(stored_feed(spark, sf_dir), (F.col("pos") < 4000) | (F.col("event_id") % 3 == 0))


INDEX = f"""{WITH}, x AS (
  SELECT *, coalesce(CASE WHEN json_valid(payload) THEN CASE json_type(payload, '$.tag') WHEN 'BOOLEAN' THEN 1 WHEN 'UBIGINT' THEN 2 WHEN 'BIGINT' THEN 2 WHEN 'VARCHAR' THEN 4 END END, 0) AS tag_type,
    CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.tag') END AS tag_value
  FROM (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1)),
i AS (SELECT key, event_id, event_type, tag_type, tag_value FROM x)"""
POSTINGS = """, e AS (SELECT 'by_kind' AS index_name, event_type AS "values", key FROM i UNION ALL SELECT 'by_tag', event_type || '|' || coalesce(tag_value, '-'), key FROM i)"""
STORE = """WITH j AS (SELECT event_id AS seq, CASE WHEN event_id = 1500 THEN 'clear' WHEN event_id % 11 = 0 THEN 'delete' ELSE 'put' END AS op, 'k-' || (event_id % 997) AS key,
    event_type AS named, CAST(round(value * 100) AS BIGINT) AS amount, 'm-' || (event_id // 2 * 2 + CASE WHEN event_id % 6 = 1 THEN 0 ELSE event_id % 2 END) AS mutation_id, sha256(CAST(event_id % 3 AS VARCHAR)) AS digest FROM events),
s AS (SELECT * FROM (SELECT * FROM j WHERE op <> 'clear' AND seq > coalesce((SELECT max(seq) FROM j WHERE op = 'clear'), -1) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 'put')"""
COVER = """leases AS (SELECT 'w-' || lpad(i::VARCHAR, 2, '0') AS work_id, i % 5 <> 4 AS live, i % 4 = 0 AS pin, i FROM range(12) t(i)),
live AS (SELECT *, row_number() OVER (ORDER BY work_id) - 1 AS nth FROM leases WHERE live),
cov AS (SELECT w::INT AS window, coalesce((SELECT min(work_id) FROM live WHERE pin AND (w = i * 3 OR w = i * 3 + 1)), (SELECT work_id FROM live WHERE nth = w % (SELECT count(*) FROM live))) AS work_id FROM range(256) r(w))"""
DIVIDED = f'{WITH}, {COVER}, d AS (SELECT feed.*, (\'0x\' || substr(sha256(key), 15, 2))::INT AS win FROM feed), c AS (SELECT "window" AS win FROM cov WHERE work_id IN (\'w-00\', \'w-03\'))'

QUERIES = {f.__name__: f for f in (index_latest, index_exact, index_exact_null, index_prefix, index_range, index_range_open, index_unique_first, index_resolve, index_gaps, index_delete, index_retire, index_page_bytes, index_latest_posting, index_claims_fold, store_fold, store_get_by, store_range, store_iterate, store_iterate_pinned, store_mutations, store_unique_fold, store_accumulate, store_accumulate_claims, sub_starts, sub_fetch, sub_seek_timestamp, sub_delivery_delay, sub_coverage, sub_windowed_deliver, sub_deferred, sub_attempts, frontier_split, frontier_merge)}
SQL = {
    "index_latest": f"{INDEX} SELECT * FROM i",
    "index_exact": f"{INDEX} SELECT * FROM i WHERE event_type = 'click' AND tag_type = 1 AND tag_value = 'true' ORDER BY key LIMIT 1000",
    "index_exact_null": f"{INDEX} SELECT * FROM i WHERE event_type = 'click' AND tag_type = 0 ORDER BY key LIMIT 1000",
    "index_prefix": f"{INDEX} SELECT * FROM i WHERE event_type = 'click' AND tag_type = 4 AND starts_with(tag_value, 't') ORDER BY tag_value, key LIMIT 1000",
    "index_range": f"{INDEX} SELECT * FROM i WHERE event_type = 'click' AND (tag_type = 2 AND tag_value::BIGINT > 2 OR tag_type = 3 OR tag_type = 4 AND tag_value <= 't3')",
    "index_range_open": f"{INDEX} SELECT * FROM i WHERE event_type = 'click' AND (tag_type < 2 OR tag_type = 2 AND tag_value::BIGINT < 4)",
    "index_unique_first": "SELECT c_custkey::VARCHAR AS key, c_nationkey::VARCHAR AS nation, c_nationkey IS NOT NULL AND row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) > 1 AS conflicted FROM customer",
    "index_resolve": f"{INDEX}{POSTINGS} SELECT index_name, \"values\", e.key, event_id FROM e JOIN i ON i.key = e.key",
    "index_gaps": f"{INDEX}{POSTINGS} SELECT index_name, \"values\", key FROM e WHERE key IN (SELECT key FROM i WHERE event_type = 'click')",
    "index_delete": f"{INDEX} SELECT 'k-' || (c_custkey * 3) AS key, 'k-' || (c_custkey * 3) IN (SELECT key FROM i) AS deleted, false AS still FROM customer",
    "index_retire": f"{INDEX}{POSTINGS} SELECT * FROM e WHERE index_name = 'by_kind'",
    "index_page_bytes": f"{INDEX} SELECT key, event_id, used::BIGINT AS used_bytes FROM (SELECT key, event_id, sum(strlen(payload)) OVER (ORDER BY key) AS used, row_number() OVER (ORDER BY key) AS n FROM x) WHERE used <= 4096 AND n <= 1000",
    "index_latest_posting": f"{WITH} SELECT pos, key, pos = max(pos) OVER (PARTITION BY key) AS current FROM feed",
    "store_accumulate_claims": f"""{STORE}, r AS (SELECT key, substr(key, 3)::INT % 300 AS value, count(*) AS count, sum(amount)::BIGINT AS sum, min(seq) AS first FROM j GROUP BY 1, 2)
      SELECT key, value, count, sum, first <> min(first) OVER (PARTITION BY value) AS conflicted FROM r""",
    "sub_starts": f"{WITH} SELECT 'BEGINNING' AS start, 0::BIGINT AS after_pos UNION ALL SELECT 'NOW', max(pos) FROM feed UNION ALL SELECT 'TIMESTAMP', coalesce(max(pos), 0) FROM feed WHERE ingest_time_ns < {DAY_10} UNION ALL SELECT 'CURSOR', 321",
    "sub_fetch": f"""{DIVIDED.replace("('w-00', 'w-03')", "('w-00', 'w-03', 'w-05')")} SELECT pos, event_id, win AS window, pos <= 800 AS redelivered FROM d SEMI JOIN c USING (win) WHERE pos > 800 OR event_id % 3 = 0 ORDER BY redelivered DESC, pos LIMIT 300""",
    "store_fold": f"{STORE} SELECT key, seq, named, amount FROM s",
    "store_get_by": f"{STORE} SELECT key, seq, amount FROM s WHERE named = 'view' ORDER BY key LIMIT 1000",
    "store_range": f"{STORE} SELECT key, amount FROM s WHERE amount >= 1000 AND amount < 4000 ORDER BY amount, key LIMIT 1000",
    "store_iterate": f"{STORE}, p AS (SELECT key, seq, row_number() OVER (ORDER BY key) AS n FROM s WHERE key > 'k-3') SELECT key, seq, CASE WHEN (SELECT max(n) FROM p) > 100 THEN (SELECT key FROM p WHERE n = 100) END AS next_key FROM p WHERE n <= 100",
    "store_iterate_pinned": f"{STORE}, n AS (SELECT * FROM (SELECT * FROM j WHERE seq <= 900 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 'put'), p AS (SELECT key, seq, row_number() OVER (ORDER BY key) AS n FROM n WHERE key > 'k-5') SELECT key, seq, CASE WHEN (SELECT max(n) FROM p) > 50 THEN (SELECT key FROM p WHERE n = 50) END AS next_key, 900::BIGINT AS pinned_seq FROM p WHERE n <= 50",
    "store_mutations": f"{STORE} SELECT seq, mutation_id, CASE WHEN row_number() OVER w = 1 THEN 'applied' WHEN digest = first_value(digest) OVER w THEN 'deduplicated' ELSE 'conflict' END AS status FROM j WINDOW w AS (PARTITION BY mutation_id ORDER BY seq)",
    "store_accumulate": f"{STORE} SELECT named, count(*) AS count, sum(amount)::BIGINT AS sum FROM j GROUP BY named",
    "sub_seek_timestamp": f"{WITH} SELECT coalesce(max(pos), 0) AS after_pos FROM feed WHERE ingest_time_ns < {DAY_10}",
    "sub_delivery_delay": f"{WITH} SELECT pos, event_id, key FROM feed f WHERE ingest_time_ns <= {DAY_10 - 3600 * 10**9} AND NOT EXISTS (SELECT 1 FROM feed g WHERE g.key = f.key AND g.pos < f.pos AND g.ingest_time_ns > {DAY_10 - 3600 * 10**9})",
    "sub_coverage": f"WITH {COVER} SELECT * FROM cov",
    "sub_windowed_deliver": f"{DIVIDED} SELECT pos, event_id, win AS window FROM d SEMI JOIN c USING (win)",
    "sub_deferred": f"{DIVIDED} SELECT win AS window, count(*) AS records, min(pos) AS first_pos FROM d ANTI JOIN c USING (win) GROUP BY win",
    "sub_attempts": f"{WITH} SELECT key, count(*) AS attempts, CASE WHEN count(*) > 10 THEN 'quarantine' ELSE 'retry' END AS action FROM feed GROUP BY key",
    "frontier_split": f"{WITH} SELECT CASE WHEN substr(sha256(key), 1, 32) < '8' || repeat('0', 31) THEN 'left' ELSE 'right' END AS side, max(pos) AS frontier FROM (SELECT * FROM feed QUALIFY pos < max(pos) OVER (PARTITION BY key)) GROUP BY 1",
    "frontier_merge": f"{WITH} SELECT coalesce(min(pos) FILTER (NOT (pos < 4000 OR event_id % 3 = 0)), max(pos) + 1) - 1 AS frontier FROM feed",
}
