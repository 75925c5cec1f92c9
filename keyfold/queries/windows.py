"""Window pipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyfold.functions.typed import duration_ns
from keyfold.operators import pipes
from keyfold.plans.declarations import WindowPipe
from keyfold.sources.feeds import FEED_SQL, events_feed, stored_feed

WITH = "WITH " + FEED_SQL
PANE = duration_ns("1h")
NOW = 1705312800000000000  # 2024-01-15 10:00
STORE_SEQ = 7
COLUMNS = ["group_tag", "group_value", "pane", "posting", "count"]


def _pipe(**more) -> WindowPipe:
    return WindowPipe(**{"group_path": "customer", "window_ns": duration_ns("16h"), "max_late_ns": duration_ns("1h")} | more)


def _out(d, *more):
    return d.select(F.col("group_tag").cast("int").alias("group_tag"), *COLUMNS[1:], F.col("sum").cast("long").alias("sum"), *more)


def window_count(spark, sf_dir):
    return _out(pipes.window(events_feed(spark, sf_dir), _pipe()))


def window_sum(spark, sf_dir):
    return _out(pipes.window(events_feed(spark, sf_dir), _pipe(value_path="cents")))


def window_sum_mixed(spark, sf_dir):
    """Only integers among the mixed-type values count."""
    return _out(pipes.window(events_feed(spark, sf_dir), _pipe(value_path="tag")))


def window_avg(spark, sf_dir):
    return _out(pipes.window(events_feed(spark, sf_dir), _pipe(value_path="cents", average=True)), pipes.average().alias("average"))


def window_ingest(spark, sf_dir):
    return _out(pipes.window(events_feed(spark, sf_dir), _pipe(clock="ingest", max_late_ns=None, value_path="cents")))


def window_typed_groups(spark, sf_dir):
    """Groups of several types: the integer 1 and the text t1 stay apart."""
    return _out(pipes.window(events_feed(spark, sf_dir), _pipe(group_path="tag")))


def window_late_rows(spark, sf_dir):
    return _out(pipes.window(events_feed(spark, sf_dir), _pipe(max_late_ns=duration_ns("30m"))).where("posting = -1"))


def window_keycap(spark, sf_dir):
    return _out(pipes.window(events_feed(spark, sf_dir), _pipe(limit_keys=40)))


def window_bytecap(spark, sf_dir):
    """Rows of together at most 4 KiB, admitted as they are first seen; text and integer groups cost differently."""
    return _out(pipes.window(stored_feed(spark, sf_dir), _pipe(group_path="customer", value_path="cents", limit_bytes=4096)))


def window_caps(spark, sf_dir):
    """Both caps at once: what the key cap refuses never counts as late, nor against the bytes."""
    return _out(pipes.window(stored_feed(spark, sf_dir), _pipe(group_path="tag", limit_keys=5, limit_bytes=2048)))


def _expiring(**more):
    return _pipe(**{"value_path": "cents", "expire_ns": duration_ns("7d")} | more)


def _disposed(spark, sf_dir, pipe=None):
    pipe = pipe or _expiring()
    return pipes.disposition(pipes.window(events_feed(spark, sf_dir), pipe), pipe, NOW)


def window_expire(spark, sf_dir):
    return _out(_disposed(spark, sf_dir), "disposition")


def _emitted(spark, sf_dir, pipe):
    d = _disposed(spark, sf_dir, pipe).where("disposition = 'emit'")
    payload = pipes.emission_payload(pipe, F.lit(STORE_SEQ), F.lit(1))
    return d.select(F.col("group_tag").cast("int").alias("group_tag"), "group_value", "pane", "event_time_ns", payload.alias("payload"))


def window_emissions(spark, sf_dir):
    """Averages by customer."""
    return _emitted(spark, sf_dir, _expiring(average=True))


def window_emissions_count(spark, sf_dir):
    """Counts by groups of several types, which keep their JSON type."""
    return _emitted(spark, sf_dir, _expiring(value_path=None, group_path="tag"))


def window_rolling(spark, sf_dir):
    d = pipes.rolling_totals(pipes.window(events_feed(spark, sf_dir), _pipe(value_path="cents")))
    return d.select("group_value", "pane", "rolling_count", F.col("rolling_sum").cast("long").alias("rolling_sum"))


def _paged(spark, sf_dir):
    pipe = _pipe(value_path="cents", max_late_ns=None, watermark_ns=duration_ns("30m"), grace_ns=duration_ns("20m"))
    return pipes.window_by_watermark(stored_feed(spark, sf_dir), pipe)


def window_watermark_paged(spark, sf_dir):
    return _out(_paged(spark, sf_dir), "emit_page", F.col("revision").cast("long").alias("revision"))


def window_pane_totals(spark, sf_dir):
    d = pipes.pane_totals(_paged(spark, sf_dir))
    return d.select("group_value", "pane", "count", F.col("sum").cast("long").alias("sum"))


def _sql(value: str = "'i'", late: int = 3600 * 10**9, clock: str = "event_time_ns", group: str = "$.customer", head: str = "p", admit: str = "") -> str:
    """CTEs ``base`` (projected records) and ``w`` (pane and late rows)."""
    value_sql = "2 AS vt, 0 AS v" if value == "'i'" else (
        f"CASE WHEN json_type(payload, '{value}') IN ('UBIGINT', 'BIGINT') THEN 2 ELSE 0 END AS vt, CASE WHEN json_type(payload, '{value}') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(payload, '{value}') AS BIGINT) END AS v"
    )
    return f"""{WITH}, base AS (
  SELECT CASE json_type(payload, '{group}') WHEN 'BOOLEAN' THEN 1 WHEN 'UBIGINT' THEN 2 WHEN 'BIGINT' THEN 2 WHEN 'VARCHAR' THEN 4 ELSE 0 END AS group_tag,
    json_extract_string(payload, '{group}') AS group_value, greatest({clock}, 0) // {PANE} AS pane, ingest_time_ns - event_time_ns > {late} AS late, pos, event_time_ns, {value_sql}
  FROM feed WHERE json_valid(payload)),
b AS (SELECT * FROM base WHERE group_tag <> 0),
{admit or 'a AS (SELECT * FROM b)'},
w AS (
  SELECT group_tag, group_value, pane, 0 AS posting, count(*) AS count, coalesce(sum(v), 0)::BIGINT AS sum FROM a WHERE NOT late AND vt = 2 GROUP BY ALL
  UNION ALL
  SELECT group_tag, group_value, -1, -1, count(*), 0 FROM a WHERE late GROUP BY ALL)"""


CAP = "ok AS (SELECT DISTINCT group_tag, group_value FROM b ORDER BY group_tag, group_value LIMIT 40), a AS (SELECT b.* FROM b SEMI JOIN ok USING (group_tag, group_value))"
NEVER = 10**18
CAP_5 = CAP.replace("LIMIT 40", "LIMIT 5").replace("ORDER BY group_tag, group_value", "ORDER BY group_tag, CASE group_tag WHEN 2 THEN CAST(group_value AS BIGINT) END, group_value")
# Rows are admitted in the order they are first seen, as long as what they cost is left: a fold over the list of rows.
BYTES = """t AS (SELECT *, CASE WHEN late THEN -1 ELSE pane END AS row_pane FROM {src} WHERE late OR vt = 2),
u AS (SELECT group_tag, group_value, row_pane, min(pos) AS first_pos, CASE group_tag WHEN 1 THEN 1 WHEN 2 THEN 8 ELSE strlen(group_value) END + 39 AS cost FROM t GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY first_pos) AS id FROM u),
z AS (SELECT list_reduce(list(struct_pack(used := cost::BIGINT, own := [id::BIGINT]) ORDER BY id), lambda acc, x: CASE WHEN acc.used + x.used <= {limit} THEN struct_pack(used := acc.used + x.used, own := list_concat(acc.own, x.own)) ELSE acc END, struct_pack(used := 0::BIGINT, own := []::BIGINT[])) AS f FROM o),
fit AS (SELECT group_tag, group_value, row_pane FROM o, z WHERE list_contains(f.own, id))"""
CAPPED = """SELECT group_tag, group_value, row_pane AS pane, CASE WHEN row_pane < 0 THEN -1 ELSE 0 END AS posting, count(*) AS count, coalesce(sum(CASE WHEN row_pane >= 0 THEN v END), 0)::BIGINT AS sum FROM t SEMI JOIN fit USING (group_tag, group_value, row_pane) GROUP BY ALL
  UNION ALL SELECT 4, '__bytecap__', -1, -1, count(*), 0 FROM t ANTI JOIN fit USING (group_tag, group_value, row_pane) HAVING count(*) > 0"""
_DISPOSED = f"""d AS (SELECT *, CASE WHEN posting <> 0 THEN 'keep' WHEN {NOW} >= (pane + 1) * {PANE} + 604800000000000 THEN 'expire'
  WHEN {NOW} >= (pane + 1) * {PANE} + 3600000000000 THEN 'emit' ELSE 'keep' END AS disposition FROM w)"""
DISPOSED_TAGS = f"{_sql(group='$.tag')}, {_DISPOSED}"


def _emissions(average: bool) -> str:
    """Emitted panes with their JSON, written from the wire form: decimal strings, null for what is not aggregated."""
    mean = "regexp_replace((sum::DOUBLE / greatest(count, 1))::VARCHAR, '\\.0$', '')"
    text = "to_json(group_value)::VARCHAR"
    more = f"""'","count":' || count || ',"sum":' || {"'" + '"' + "' || sum || '" + '"' + "'" if average else "'null'"} || ',"average":' || {"'" + '"' + "' || " + mean + " || '" + '"' + "'" if average else "'null'"}"""
    return f""" SELECT group_tag, group_value, pane, (pane + 1) * {PANE} - 1 AS event_time_ns,
      '{{"group":' || CASE WHEN group_tag IN (1, 2) THEN group_value ELSE {text} END || ',"pane":' || pane || ',"pane_start_ns":"' || (pane * {PANE}) || '","pane_end_ns":"' || ((pane + 1) * {PANE})
      || {more} || ',"store_seq":"{STORE_SEQ}","revision":"1"}}' AS payload FROM d WHERE disposition = 'emit'"""


DISPOSED = f"""{_sql('$.cents')}, d AS (SELECT *, CASE WHEN posting <> 0 THEN 'keep' WHEN {NOW} >= (pane + 1) * {PANE} + 604800000000000 THEN 'expire'
  WHEN {NOW} >= (pane + 1) * {PANE} + 3600000000000 THEN 'emit' ELSE 'keep' END AS disposition FROM w)"""
MARK, GRACE = 1800 * 10**9, 1200 * 10**9
PAGED = f"""{_sql('$.cents', NEVER)}, pages AS (
  SELECT (pos - 1) // 64 AS page, greatest(max(max(event_time_ns)) OVER (ORDER BY (pos - 1) // 64) - {MARK}, 0) AS horizon FROM feed GROUP BY 1),
j AS (SELECT b.*, (b.pos - 1) // 64 AS page, horizon, (pane + 1) * {PANE} AS pend FROM b JOIN pages ON pages.page = (b.pos - 1) // 64),
l AS (SELECT *, pend <= horizon AND horizon > pend + {GRACE} AS islate FROM j),
c AS (SELECT pane, min(pages.page) AS cp FROM (SELECT DISTINCT pane FROM b) x LEFT JOIN pages ON horizon >= (pane + 1) * {PANE} GROUP BY pane),
k AS (SELECT group_tag, group_value, l.pane, CASE WHEN cp IS NOT NULL THEN greatest(l.page, cp) + 1 END AS emit_page, count(*) AS count, sum(v)::BIGINT AS sum
  FROM l JOIN c ON c.pane = l.pane WHERE NOT islate AND vt = 2 GROUP BY ALL),
r AS (SELECT group_tag, group_value, pane, 0 AS posting, count, sum, emit_page,
    CASE WHEN emit_page IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY group_tag, group_value, pane ORDER BY emit_page NULLS LAST) END AS revision FROM k
  UNION ALL SELECT group_tag, group_value, -1, -1, count(*), 0, NULL, 0 FROM l WHERE islate GROUP BY ALL)"""

QUERIES = {f.__name__: f for f in (window_count, window_sum, window_sum_mixed, window_avg, window_ingest, window_typed_groups, window_late_rows, window_keycap, window_bytecap, window_caps, window_expire, window_emissions, window_emissions_count, window_rolling, window_watermark_paged, window_pane_totals)}
SQL = {
    "window_count": f"{_sql()} SELECT * FROM w",
    "window_sum": f"{_sql('$.cents')} SELECT * FROM w",
    "window_sum_mixed": f"{_sql('$.tag')} SELECT * FROM w",
    "window_avg": f"{_sql('$.cents')} SELECT *, sum::DOUBLE / greatest(count, 1) AS average FROM w",
    "window_ingest": f"{_sql('$.cents', NEVER, 'ingest_time_ns')} SELECT * FROM w",
    "window_typed_groups": f"{_sql(group='$.tag')} SELECT * FROM w",
    "window_late_rows": f"{_sql(late=1800 * 10**9)} SELECT * FROM w WHERE posting = -1",
    "window_keycap": f"{_sql(admit=CAP)} SELECT * FROM w UNION ALL SELECT 4, '__keycap__', -1, -1, count(*), 0 FROM b ANTI JOIN ok USING (group_tag, group_value) HAVING count(*) > 0",
    "window_expire": f"{DISPOSED} SELECT * FROM d",
    "window_emissions": f"{DISPOSED}{_emissions(True)}",
    "window_emissions_count": f"{DISPOSED_TAGS}{_emissions(False)}",
    "window_bytecap": f"{_sql('$.cents')}, {BYTES.format(src='a', limit=4096)} {CAPPED}",
    "window_caps": f"{_sql(group='$.tag', admit=CAP_5)}, {BYTES.format(src='a', limit=2048)} {CAPPED} UNION ALL SELECT 4, '__keycap__', -1, -1, count(*), 0 FROM b ANTI JOIN ok USING (group_tag, group_value) HAVING count(*) > 0",
    "window_rolling": f"{_sql('$.cents')} SELECT group_value, pane, (sum(count) OVER r)::BIGINT AS rolling_count, (sum(sum) OVER r)::BIGINT AS rolling_sum FROM w WHERE posting = 0 WINDOW r AS (PARTITION BY group_tag, group_value ORDER BY pane RANGE BETWEEN 15 PRECEDING AND CURRENT ROW)",
    "window_watermark_paged": f"{PAGED} SELECT * FROM r",
    "window_pane_totals": f"{PAGED} SELECT group_value, pane, sum(count)::BIGINT AS count, sum(sum)::BIGINT AS sum FROM r WHERE posting = 0 GROUP BY group_tag, group_value, pane",
}
