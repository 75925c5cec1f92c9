"""Demand analytics, retention, policies and access."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyfold.functions import typed
from keyfold.operators import demand, governance, indexes, reads, subscriptions
from keyfold.sources.feeds import FEED_SQL, events_feed, stored_feed
from keyfold.sources.shared import table

WITH = "WITH " + FEED_SQL
DAY = 86400 * 10**9
NOW = 1706600000000000000


def _by_user(spark, sf_dir):
    return stored_feed(spark, sf_dir).withColumn("key", F.concat(F.lit("u"), F.col("user_id")))


def _counts(spark, sf_dir):
    return demand.rollup(_by_user(spark, sf_dir), F.expr(f"ingest_time_ns div {DAY}L"), tracked=100)


def demand_rollup(spark, sf_dir):
    return _counts(spark, sf_dir).select("window", "token", "n", "bytes", "tracked")


def demand_topk(spark, sf_dir):
    return demand.top_keys(_counts(spark, sf_dir)).select("window", F.col("rank").cast("long").alias("rank"), "token", "n", "share_bp")


def demand_weighted_median(spark, sf_dir):
    return demand.weighted_median(_counts(spark, sf_dir))


def demand_isolation(spark, sf_dir):
    d = demand.next_tokens(_counts(spark, sf_dir))
    return d.withColumn("boundary", demand.isolation_boundary(F.col("top"), F.col("next"), F.lit("2"), F.lit("e")))


def demand_baseline(spark, sf_dir):
    hours = events_feed(spark, sf_dir).groupBy(F.col("event_type").alias("subject"), F.expr("event_time_ns div 3600000000000").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    totals = hours.selectExpr("subject", "h * 3600000000000 AS at_ns", "sum(n) OVER (PARTITION BY subject ORDER BY h) AS total")
    return demand.baseline(totals).select("subject", "rates", "state")


def hot_key_flags(spark, sf_dir):
    """Sequential per range; no SQL, held against a plain fold in tests."""
    d = events_feed(spark, sf_dir).select(
        (F.col("user_id") % 4).alias("range"), F.expr("event_time_ns div 43200000000000").alias("window"), F.when(F.expr("event_time_ns div 86400000000000 % 5 < 3"), "hot").otherwise(F.concat(F.lit("u"), F.col("user_id") % 8)).alias("token")
    )
    n = d.groupBy("range", "window", "token").agg(F.count(F.lit(1)).alias("n"))
    return demand.hot_keys(demand.window_tops(n), clear_after=2)


def _ranges(spark, step):
    """Contiguous ranges of ``step`` sixteenths; the last one ends beyond every token."""
    ends = [f"{i:x}" + "0" * 31 for i in range(step, 16, step)]
    rows = [(i * step, s, e) for i, (s, e) in enumerate(zip(["", *ends], [*ends, "f" * 33]))]
    return spark.createDataFrame(rows, "range_id int, start string, end string")


def range_route(spark, sf_dir):
    return demand.route(_by_user(spark, sf_dir), _ranges(spark, 2)).groupBy("range_id").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("key").alias("n_keys"))


def retry_delays(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 30).cast("int").alias("attempt"), F.when(F.col("event_id") % 3 == 0, F.lit(700)).alias("hint"))
    return d.select("event_id", typed.retry_delay_ms(F.col("attempt"), 50, 60_000, F.col("hint")).alias("delay_ms"))


def _segments(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("feed."), F.col("o_orderstatus"), F.col("o_custkey") % 7).alias("feed"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").cast("long").alias("bytes"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("last_ingest_ns"),
    )
    return d


CUT = 725846400000000000  # 1993-01-01


def retention_delete_set(spark, sf_dir):
    holds = spark.createDataFrame([("feed.F3",)], "feed string")
    return governance.retention(_segments(spark, sf_dir), CUT, 0, 40_000_000, holds).select("feed", "seq")


def retention_sweep(spark, sf_dir):
    """Holds beat erasure, erasure beats retention; what lies below a feed's floor is gone already."""
    segments = _segments(spark, sf_dir).withColumn("floor_seq", F.substring("feed", -1, 1).cast("long") * 30)
    holds, erased = spark.createDataFrame([("feed.F3",), ("feed.O5",)], "feed string"), spark.createDataFrame([("feed.P1",), ("feed.O5",)], "feed string")
    return governance.sweep(segments, CUT, 0, 40_000_000, holds, erased)


def policy_effective(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    feeds = c.select(
        F.concat_ws(".", F.lit("shop"), F.concat(F.lit("n"), F.col("c_nationkey")), F.concat(F.lit("c"), F.col("c_custkey"))).alias("feed"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("expire_s"), F.when(F.col("c_custkey") % 5 == 0, "JSON").alias("format"),
    )
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("shop.n"), "n_nationkey").alias("domain"), F.col("n_nationkey").cast("long").alias("expire_s"), F.lit("TEXT").alias("format"))
    root = spark.createDataFrame([("shop", 99, "BYTES")], "domain string, expire_s long, format string")
    return governance.effective_policy(feeds, nations.unionByName(root), ["expire_s", "format"])


GRANTS = [("p0", "read", "*", "allow"), ("p1", "manage", "shop", "allow"), ("p1", "write", "shop.n3", "deny"), ("p2", "read", "shop.n1", "allow"), ("p2", "manage", "shop.n1.c6", "deny"), ("p3", "read", "shop", "deny"), ("p3", "read", "shop.n2", "allow")]


def access_decisions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("shop.n"), "c_nationkey", F.lit(".c"), F.col("c_custkey")).alias("resource"), F.concat(F.lit("p"), F.col("c_custkey") % 5).alias("principal"))
    asked = c.withColumn("action", F.explode(F.array(F.lit("read"), F.lit("write"), F.lit("manage"))))
    return governance.access(asked, spark.createDataFrame(GRANTS, "principal string, action string, resource string, effect string"))


def tier_states(spark, sf_dir):
    d = _segments(spark, sf_dir).withColumn("sealed", F.col("seq") % 4 != 0)
    return governance.tier_of(d, CUT, 30 * DAY).select("seq", "tier")


def copy_lags(spark, sf_dir):
    src = _segments(spark, sf_dir).select("feed", "seq")
    return governance.copy_lag(src, src.where("seq % 10 <> 3 and feed <> 'feed.O1' or feed = 'feed.P2'"), ["feed", "seq"], 20)


def telemetry_rollup(spark, sf_dir):
    d = events_feed(spark, sf_dir).select("event_type", "event_id", "cents")
    return demand.telemetry(d, ["event_type"], ["cents"], "event_id")


def split_pressure(spark, sf_dir):
    d = events_feed(spark, sf_dir).groupBy("event_type", F.expr("event_time_ns div 3600000000000").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return demand.pressure_due(d, "event_type", "hour", F.col("n") % 3 != 0, 3)


def cold_merge(spark, sf_dir):
    """Neighbours among sixteen ranges whose keys see few records."""
    ranges = _ranges(spark, 1)
    rates = demand.route(_by_user(spark, sf_dir), ranges).groupBy("range_id").agg(F.count(F.lit(1)).alias("rate"))
    total = rates.agg(F.sum("rate").alias("t")).first()["t"]
    return demand.cold_pairs(ranges, rates, total // 16)


def adaptive_batches(spark, sf_dir):
    d = events_feed(spark, sf_dir).select("event_type", "event_id", "cents")
    return demand.batch_ewma(d, "event_type", "event_id", "cents")


def adaptive_retries(spark, sf_dir):
    d = events_feed(spark, sf_dir).select("event_type", "event_id", F.when(F.col("event_id") % 7 == 0, 1.0).otherwise(0.0).alias("retried"))
    return demand.batch_ewma(d, "event_type", "event_id", "retried", 0.9)


def range_map_gaps(spark, sf_dir):
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("range_id"), F.format_string("%03d", "n_nationkey").alias("start"), F.format_string("%03d", F.col("n_nationkey") + F.when(F.col("n_nationkey") % 6 == 5, 2).otherwise(1)).alias("end"))
    return demand.range_gaps(d).select("range_id", "end", "next_start")


def feed_names(spark, sf_dir):
    d = table(spark, sf_dir, "nation").select(F.concat(F.lit("shop.r"), "n_regionkey", F.lit(".n"), "n_nationkey").alias("feed"))
    d = governance.source_block(d)
    return d.select("feed", "short_name", reads.matches_pattern(F.col("feed"), "shop.r1.*").alias("in_r1"), reads.matches_pattern(F.col("feed"), "shop.r1").alias("is_r1"))


def index_usage(spark, sf_dir):
    modes = F.element_at(F.array(F.lit("exact"), F.lit("prefix"), F.lit("range")), (F.col("event_id") % 3 + 1).cast("int"))
    d = events_feed(spark, sf_dir).select(F.col("event_type").alias("index"), modes.alias("mode"), (F.col("cents") > 9000).alias("truncated"), (F.col("event_id") % 50 == 0).alias("behind"))
    return indexes.usage(d)


def position_sets(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_custkey") % 7, F.col("c_custkey") % 5).alias("held"), F.array(F.lit(9).cast("long"), F.col("c_custkey") % 3).alias("added"), F.array(F.col("c_custkey") % 2).alias("removed"))
    return subscriptions.set_changes(d).select("c_custkey", F.array_join("held", ",").alias("held"))


COUNTS = f"""{WITH}, c AS (
  SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY first_pos) <= 100 AS tracked FROM (
    SELECT ingest_time_ns // {DAY} AS window_id, substr(sha256('u' || user_id), 1, 32) AS token, count(*) AS n, min(pos) AS first_pos, sum(strlen(payload))::BIGINT AS bytes FROM feed GROUP BY 1, 2))"""

QUERIES = {f.__name__: f for f in (demand_rollup, demand_topk, demand_weighted_median, demand_isolation, demand_baseline, hot_key_flags, range_route, retry_delays, retention_delete_set, retention_sweep, policy_effective, access_decisions, tier_states, copy_lags, telemetry_rollup, split_pressure, cold_merge, adaptive_batches, adaptive_retries, range_map_gaps, feed_names, index_usage, position_sets)}
SQL = {
    "demand_rollup": f"{COUNTS} SELECT window_id AS window, token, n, bytes, tracked FROM c",
    "demand_topk": f"{COUNTS}, t AS (SELECT *, sum(n) OVER (PARTITION BY window_id) AS total FROM c) SELECT window_id AS window, row_number() OVER (PARTITION BY window_id ORDER BY n DESC, token) AS rank, token, n, least(n * 10000 // total, 10000)::BIGINT AS share_bp FROM t WHERE tracked QUALIFY rank <= 8",
    "demand_weighted_median": f"{COUNTS}, r AS (SELECT *, sum(CASE WHEN tracked THEN n ELSE 0 END) OVER (PARTITION BY window_id ORDER BY token) AS run, sum(n) OVER (PARTITION BY window_id) AS total FROM c) SELECT window_id AS window, min(token) FILTER (tracked AND run >= (total + 1) // 2) AS median FROM r GROUP BY 1",
    "demand_isolation": f"{COUNTS}, t AS (SELECT window_id, token AS top FROM c WHERE tracked QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY n DESC, token) = 1), x AS (SELECT t.window_id, top, (SELECT min(token) FROM c WHERE c.window_id = t.window_id AND tracked AND token > top) AS nxt FROM t) SELECT window_id AS window, top, nxt AS next, CASE WHEN top > '2' AND top < 'e' THEN top WHEN nxt > '2' AND nxt < 'e' THEN nxt END AS boundary FROM x",
    "demand_baseline": f"""{WITH}, h AS (SELECT event_type AS subject, event_time_ns // 3600000000000 AS h, count(*) AS n FROM feed GROUP BY 1, 2),
      t AS (SELECT subject, h, sum(n) OVER (PARTITION BY subject ORDER BY h) AS total FROM h),
      r AS (SELECT subject, h, (total - lag(total) OVER w) / ((h - lag(h) OVER w) * 60.0) AS rate FROM t WINDOW w AS (PARTITION BY subject ORDER BY h)),
      q AS (SELECT *, count(*) OVER (PARTITION BY subject) AS n, row_number() OVER (PARTITION BY subject ORDER BY h) AS nth FROM r WHERE rate IS NOT NULL),
      o AS (SELECT subject, max(rate) AS top, list_sort(list(rate))[count(*) // 2 + 1] AS med FROM q WHERE nth <= n - 3 GROUP BY 1)
      SELECT q.subject, max(n) AS rates, CASE WHEN max(n) < 60 THEN 'learning' WHEN bool_and(coalesce(rate > 1.5 * top OR rate > 1.5 * med OR rate < med / 1.5, false)) THEN 'out' ELSE 'normal' END AS state FROM q LEFT JOIN o USING (subject) WHERE nth > n - 3 GROUP BY 1""",
    "range_route": f"{WITH}, k AS (SELECT ('0x' || substr(sha256('u' || user_id), 1, 1))::INT // 2 * 2 AS range_id, user_id FROM feed) SELECT range_id, count(*) AS records, count(DISTINCT user_id) AS n_keys FROM k GROUP BY 1",
    "retry_delays": "SELECT event_id, least(greatest(50 * (1::BIGINT << least(event_id % 30, 20)), CASE WHEN event_id % 3 = 0 THEN 700 ELSE 0 END), 60000)::BIGINT AS delay_ms FROM events",
    "retention_delete_set": f"""WITH s AS (SELECT 'feed.' || o_orderstatus || (o_custkey % 7) AS feed, o_orderkey AS seq, CAST(trunc(o_totalprice) AS BIGINT) AS bytes, epoch_us(o_orderdate) * 1000 AS t FROM orders),
      g AS (SELECT *, t < {CUT} OR sum(bytes) OVER (PARTITION BY feed ORDER BY seq DESC) > 40000000 AS goes FROM s WHERE feed <> 'feed.F3')
      SELECT feed, seq FROM g QUALIFY coalesce(seq < min(CASE WHEN NOT goes THEN seq END) OVER (PARTITION BY feed), true)""",
    "policy_effective": """SELECT 'shop.n' || c_nationkey || '.c' || c_custkey AS feed, CASE WHEN c_nationkey % 2 = 0 THEN 'shop.n' || c_nationkey ELSE 'shop' END AS domain,
      CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_nationkey % 2 = 0 THEN c_nationkey ELSE 99 END::BIGINT AS expire_s, CASE WHEN c_custkey % 5 = 0 THEN 'JSON' WHEN c_nationkey % 2 = 0 THEN 'TEXT' ELSE 'BYTES' END AS format FROM customer""",
    "access_decisions": f"""WITH g(principal, granted, scope, effect) AS (VALUES {', '.join(map(str, GRANTS))}),
      a AS (SELECT 'shop.n' || c_nationkey || '.c' || c_custkey AS resource, 'p' || (c_custkey % 5) AS principal, unnest(['read', 'write', 'manage']) AS action FROM customer)
      SELECT resource, principal, action, (EXISTS (SELECT 1 FROM g WHERE g.principal = a.principal AND granted IN (action, 'manage') AND effect = 'allow' AND (scope = '*' OR resource = scope OR starts_with(resource, scope || '.')))
        AND NOT EXISTS (SELECT 1 FROM g WHERE g.principal = a.principal AND granted IN (action, 'manage') AND effect = 'deny' AND (scope = '*' OR resource = scope OR starts_with(resource, scope || '.')))) AS allowed FROM a""",
    "tier_states": f"SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'open' WHEN epoch_us(o_orderdate) * 1000 + {30 * DAY} <= {CUT} THEN 'move' ELSE 'deferred' END AS tier FROM orders",
    "copy_lags": "WITH s AS (SELECT 'feed.' || o_orderstatus || (o_custkey % 7) AS feed, o_orderkey AS seq FROM orders), l AS (SELECT feed, count(*) FILTER (NOT (seq % 10 <> 3 AND feed <> 'feed.O1' OR feed = 'feed.P2')) AS lag FROM s GROUP BY feed) SELECT feed, lag, CASE WHEN lag = 0 THEN 'current' WHEN lag > 20 THEN 'stalled' ELSE 'behind' END AS state FROM l",
    "telemetry_rollup": f"{WITH} SELECT event_type, count(*) AS samples, sum(cents)::BIGINT AS cents_total, arg_max(cents, event_id) AS cents_last FROM feed GROUP BY 1",
    "split_pressure": f"{WITH}, h AS (SELECT event_type, event_time_ns // 3600000000000 AS hour, count(*) AS n FROM feed GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS nth FROM h), r AS (SELECT *, nth - row_number() OVER (PARTITION BY event_type ORDER BY hour) AS run FROM p WHERE n % 3 <> 0) SELECT event_type, hour FROM r QUALIFY row_number() OVER (PARTITION BY event_type, run ORDER BY hour) % 3 = 0",
    "cold_merge": f"{WITH}, k AS (SELECT ('0x' || substr(sha256('u' || user_id), 1, 1))::INT AS r, count(*) AS n FROM feed GROUP BY 1), a AS (SELECT g::INT AS r, coalesce(n, 0) AS n FROM range(16) t(g) LEFT JOIN k ON k.r = g), m AS (SELECT sum(n) // 16 AS most FROM a) SELECT r AS \"left\", nr AS \"right\" FROM (SELECT r, n, lead(r) OVER (ORDER BY r) AS nr, lead(n) OVER (ORDER BY r) AS nn FROM a), m WHERE n <= most AND nn <= most",
    "adaptive_retries": f"{WITH} SELECT event_type, list_reduce(list(CASE WHEN event_id % 7 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY event_id), lambda a, x: a * 0.9::DOUBLE + x * (1 - 0.9::DOUBLE)) AS ewma FROM feed GROUP BY 1",
    "retention_sweep": f"""WITH s AS (SELECT 'feed.' || o_orderstatus || (o_custkey % 7) AS feed, o_orderkey AS seq, CAST(trunc(o_totalprice) AS BIGINT) AS bytes, epoch_us(o_orderdate) * 1000 AS t FROM orders),
      h AS (SELECT * FROM s WHERE feed NOT IN ('feed.F3', 'feed.O5')),
      g AS (SELECT *, t < {CUT} OR sum(bytes) OVER (PARTITION BY feed ORDER BY seq DESC) > 40000000 AS goes FROM h WHERE feed <> 'feed.P1' AND seq >= right(feed, 1)::INT * 30)
      SELECT feed, seq, 'erased' AS cause FROM h WHERE feed = 'feed.P1'
      UNION ALL SELECT feed, seq, 'retention' FROM (SELECT feed, seq FROM g QUALIFY coalesce(seq < min(CASE WHEN NOT goes THEN seq END) OVER (PARTITION BY feed), true))""",
    "adaptive_batches": f"{WITH} SELECT event_type, list_reduce(list(cents::DOUBLE ORDER BY event_id), lambda a, x: a * 0.8::DOUBLE + x * (1 - 0.8::DOUBLE)) AS ewma FROM feed GROUP BY 1",
    "range_map_gaps": "WITH r AS (SELECT n_nationkey AS range_id, lpad(n_nationkey::VARCHAR, 3, '0') AS s, lpad((n_nationkey + CASE WHEN n_nationkey % 6 = 5 THEN 2 ELSE 1 END)::VARCHAR, 3, '0') AS e FROM nation), l AS (SELECT range_id, e, lead(s) OVER (ORDER BY s) AS nx FROM r) SELECT range_id, e AS \"end\", nx AS next_start FROM l WHERE nx IS NOT NULL AND nx <> e",
    "feed_names": "SELECT 'shop.r' || n_regionkey || '.n' || n_nationkey AS feed, 'n' || n_nationkey AS short_name, n_regionkey = 1 AS in_r1, false AS is_r1 FROM nation",
    "index_usage": f"{WITH} SELECT event_type AS \"index\", ['exact', 'prefix', 'range'][event_id % 3 + 1] AS mode, count(*) AS lookups, count(*) FILTER (cents > 9000) AS truncated, count(*) FILTER (event_id % 50 = 0) AS behind FROM feed GROUP BY 1, 2",
    "position_sets": "SELECT c_custkey, array_to_string(list_sort(list_filter(list_distinct([c_custkey % 7, c_custkey % 5, 9, c_custkey % 3]), lambda x: x <> c_custkey % 2)), ',') AS held FROM customer",
}
