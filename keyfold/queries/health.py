"""Diagnostic rules over evidence made from the star tables, and what they add up to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.operators import diagnostics
from keyfold.sources.feeds import FEED_SQL, events_feed
from keyfold.sources.shared import table

WITH = "WITH " + FEED_SQL
DAY = 86400 * 10**9
NOW = 1706600000000000000


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier")


def _live(spark, sf_dir):
    """Liveness of owners: nations of region 0 are not known, those of region 1 are dead."""
    return table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("owner"), (F.col("n_regionkey") != 1).alias("alive"))


def diagnostics_control_plane(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    return diagnostics.control_plane(region.select(F.col("r_regionkey").alias("node"), (F.col("r_regionkey") % 3 != 0).alias("replicated"), F.when(F.col("r_regionkey") % 2 == 0, "n1").alias("leader")))


def diagnostics_nodes(spark, sf_dir):
    d = _suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") == 1).alias("local"), (F.col("s_suppkey") * 37 % 100 * 100).alias("last_seen_age_ms"))
    return diagnostics.nodes(d, 5000)


def diagnostics_storage(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("draining", "retired", "capacity stale", "below baseline", "no disk")])
    out = F.when(F.col("s_suppkey") % 3 != 0, F.array(F.get(kinds, (F.col("s_suppkey") % 5).cast("int")))).otherwise(F.array().cast("array<string>"))
    out = F.when(F.col("s_suppkey") % 7 == 0, F.array_append(out, "capacity unreported")).otherwise(out)
    d = _suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") < 3).alias("eligible"), out.alias("exclusions"))
    return diagnostics.storage(d)


def diagnostics_writers(spark, sf_dir):
    d = events_feed(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("k"))
    hot = d.where("n >= 10").select(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("f"), "user_id")).alias("feed"), F.col("user_id").alias("range"), F.col("n").alias("share_bps"))
    return diagnostics.writers(hot)


def diagnostics_readers(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), "c_custkey").alias("reader"), (F.col("c_custkey") % 4 - 2).alias("last_retry_after_ms"))
    return diagnostics.readers(d)


def diagnostics_subscriptions(spark, sf_dir):
    d = _suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("subscription"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("owner"))
    return diagnostics.subscriptions(d, _live(spark, sf_dir))


def diagnostics_pipes(spark, sf_dir):
    d = _suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("pipe"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("owner"), (F.col("s_suppkey") % 3 == 0).alias("paused"))
    return diagnostics.pipes(d, _live(spark, sf_dir))


def diagnostics_copies(spark, sf_dir):
    state = F.when(F.col("s_suppkey") % 6 == 0, "stalled").otherwise("current")
    d = _suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("copy"), state.alias("state"), (F.col("s_suppkey") * 7919 % 120_000).alias("report_age_ms"))
    return diagnostics.copies(d)


def diagnostics_indexes(spark, sf_dir):
    state = F.when(F.col("s_suppkey") % 9 == 0, "building").otherwise("active")
    return diagnostics.indexes(_suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("index"), state.alias("state")))


RULES = (
    diagnostics_control_plane, diagnostics_nodes, diagnostics_storage, diagnostics_writers, diagnostics_readers,
    diagnostics_subscriptions, diagnostics_pipes, diagnostics_copies, diagnostics_indexes,
)


def _all(spark, sf_dir) -> DataFrame:
    return reduce(DataFrame.unionByName, [rule(spark, sf_dir) for rule in RULES])


def diagnostics_explain(spark, sf_dir):
    return diagnostics.explain(_all(spark, sf_dir)).select("stage_order", "stage", "status", "findings")


def diagnostics_recommend(spark, sf_dir):
    return diagnostics.recommend(_all(spark, sf_dir)).select(F.col("rank").cast("long").alias("rank"), "stage", "resource", "severity", "reason")


def signals_scoped(spark, sf_dir):
    """The feed's own signals are a few users' events; the domain's and the node's fill the rest of the report."""
    scope = F.when(F.col("user_id") % 40 == 0, "feed:f").when(F.col("user_id") % 40 == 1, "domain:d").when(F.col("user_id") % 3 == 0, "node:n").otherwise("feed:other")
    e = events_feed(spark, sf_dir).select(F.col("event_id").alias("signal_id"), F.when(F.col("event_id") % 17 != 0, F.col("event_time_ns")).alias("at_ns"), scope.alias("scope"))
    d = diagnostics.scoped_signals(e, "f", "d", NOW)
    return d.select("signal_id", "scope", F.col("scope_rank").cast("int").alias("scope_rank"), "truncated")


OWNER = "CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END"
LIVE = "(SELECT n_nationkey AS owner, n_regionkey <> 1 AS alive FROM nation WHERE n_regionkey <> 0) l"
RULE_SQL = {
    "diagnostics_control_plane": "SELECT 'control plane' AS stage, r_regionkey::VARCHAR AS resource, CASE WHEN r_regionkey % 3 = 0 THEN 'advisory' ELSE 'unhealthy' END AS severity, CASE WHEN r_regionkey % 3 = 0 THEN 'not replicated' ELSE 'no leader' END AS reason FROM region WHERE r_regionkey % 3 = 0 OR r_regionkey % 2 <> 0",
    "diagnostics_nodes": "SELECT 'nodes' AS stage, s_suppkey::VARCHAR AS resource, 'degraded' AS severity, 'silent' AS reason FROM supplier WHERE s_suppkey <> 1 AND s_suppkey * 37 % 100 * 100 > 5000",
    "diagnostics_storage": """SELECT 'storage' AS stage, s_suppkey::VARCHAR AS resource, CASE WHEN x IN ('draining', 'retired') THEN 'advisory' ELSE 'degraded' END AS severity, x AS reason FROM (
      SELECT s_suppkey, unnest(list_concat(CASE WHEN s_suppkey % 3 <> 0 THEN [['draining', 'retired', 'capacity stale', 'below baseline', 'no disk'][s_suppkey % 5 + 1]] ELSE [] END, CASE WHEN s_suppkey % 7 = 0 THEN ['capacity unreported'] ELSE [] END)) AS x FROM supplier)
      UNION ALL SELECT 'storage', 'storage pool', 'unhealthy', 'too few eligible nodes' FROM supplier HAVING count(*) > 0 AND count(*) FILTER (s_suppkey < 3) < 3""",
    "diagnostics_writers": "SELECT 'writers' AS stage, CASE WHEN user_id % 2 = 0 THEN 'f' || user_id ELSE 'range ' || user_id END AS resource, 'advisory' AS severity, 'hot key' AS reason FROM events GROUP BY user_id HAVING count(*) >= 10",
    "diagnostics_readers": "SELECT 'readers' AS stage, 'r' || c_custkey AS resource, 'degraded' AS severity, 'paced' AS reason FROM customer WHERE c_custkey % 4 - 2 > 0",
    "diagnostics_subscriptions": f"""SELECT 'subscriptions' AS stage, s_suppkey::VARCHAR AS resource, CASE WHEN o IS NOT NULL AND alive IS NULL THEN 'advisory' ELSE 'degraded' END AS severity,
      CASE WHEN o IS NULL THEN 'no owner' WHEN alive IS NULL THEN 'owner unknown' ELSE 'owner dead' END AS reason FROM (SELECT s_suppkey, {OWNER} AS o FROM supplier) LEFT JOIN {LIVE} ON o = owner WHERE alive IS NOT TRUE""",
    "diagnostics_pipes": f"""SELECT 'pipes' AS stage, s_suppkey::VARCHAR AS resource, 'advisory' AS severity, 'paused' AS reason FROM supplier WHERE s_suppkey % 3 = 0
      UNION ALL SELECT 'pipes', s_suppkey::VARCHAR, CASE WHEN alive IS NULL THEN 'advisory' ELSE 'degraded' END, CASE WHEN alive IS NULL THEN 'owner unknown' ELSE 'owner dead' END
      FROM (SELECT s_suppkey, {OWNER} AS o FROM supplier) LEFT JOIN {LIVE} ON o = owner WHERE o IS NOT NULL AND alive IS NOT TRUE""",
    "diagnostics_copies": """SELECT 'copies' AS stage, s_suppkey::VARCHAR AS resource, 'degraded' AS severity, 'stalled' AS reason FROM supplier WHERE s_suppkey % 6 = 0
      UNION ALL SELECT 'copies', s_suppkey::VARCHAR, 'degraded', 'report stale' FROM supplier WHERE s_suppkey * 7919 % 120000 > 60000""",
    "diagnostics_indexes": "SELECT 'indexes' AS stage, s_suppkey::VARCHAR AS resource, 'advisory' AS severity, 'building' AS reason FROM supplier WHERE s_suppkey % 9 = 0",
}
ALL = f"""WITH f AS ({' UNION ALL '.join(f'({x})' for x in RULE_SQL.values())}),
s(place, stage) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(('control plane', 'nodes', 'storage', 'writers', 'readers', 'subscriptions', 'pipes', 'copies', 'indexes')))}),
g AS (SELECT f.*, place, list_position(['healthy', 'advisory', 'limited', 'degraded', 'unhealthy'], severity) AS sev FROM f JOIN s USING (stage))"""

QUERIES = {f.__name__: f for f in (*RULES, diagnostics_explain, diagnostics_recommend, signals_scoped)}
SQL = {
    **RULE_SQL,
    "diagnostics_explain": f"""{ALL} SELECT s.place AS stage_order, s.stage, ['healthy', 'advisory', 'limited', 'degraded', 'unhealthy'][coalesce(max(CASE WHEN reason = 'not replicated' THEN 3 ELSE sev END), 1)] AS status,
      least(count(sev), 64) AS findings FROM s LEFT JOIN g USING (stage) GROUP BY s.place, s.stage""",
    "diagnostics_recommend": f"{ALL} SELECT row_number() OVER (ORDER BY sev DESC, place, resource, reason) AS rank, stage, resource, severity, reason FROM g QUALIFY rank <= 16",
    "signals_scoped": f"""{WITH}, s AS (SELECT event_id AS signal_id, CASE WHEN event_id % 17 <> 0 THEN event_time_ns END AS at_ns, CASE WHEN user_id % 40 = 0 THEN 'feed:f' WHEN user_id % 40 = 1 THEN 'domain:d' WHEN user_id % 3 = 0 THEN 'node:n' ELSE 'feed:other' END AS scope FROM feed),
      r AS (SELECT *, CASE scope WHEN 'feed:f' THEN 0 WHEN 'domain:d' THEN 1 WHEN 'node:n' THEN 2 END AS scope_rank FROM s WHERE scope <> 'feed:other' AND (at_ns IS NULL OR at_ns >= {NOW - DAY}))
      SELECT signal_id, scope, scope_rank, greatest((SELECT count(*) FROM r) - 128, 0) AS truncated FROM r ORDER BY scope_rank, at_ns DESC NULLS LAST, signal_id LIMIT 128""",
}
