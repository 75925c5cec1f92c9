"""Feeds: append-only records in delivery order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions.ordering import with_position
from keyfold.sources.shared import exists, new_path, table

HOUR = 3600 * 10**9
#: Records of a log that are ranked together, about.
BUCKET_ROWS = 100_000
_logs: dict[tuple[str, str], str] = {}
STEP = 600 * 10**9


def project_events(events: DataFrame) -> DataFrame:
    """``events`` rows as records: lateness of up to two hours, mixed-type and bad payloads."""
    event_time = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    cents = F.round(F.col("value") * 100).cast("long")
    tag = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(',"tag":'), F.col("event_id") % 7))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit(',"tag":"t'), F.col("event_id") % 7, F.lit('"')))
        .when(F.col("event_id") % 4 == 2, F.lit(',"tag":true'))
        .otherwise("")
    )
    body = F.concat(
        F.lit('{"customer":"u'), F.col("user_id"), F.lit('","cents":'), cents, tag, F.lit(',"nested":'), F.col("props"), F.lit("}")
    )
    return events.select(
        "event_id",
        F.concat(F.lit("k-"), F.col("event_id") % 997).alias("key"),
        F.col("user_id"),
        "event_type",
        event_time.alias("event_time_ns"),
        (event_time + F.col("event_id") * 7919 % 13 * STEP).alias("ingest_time_ns"),
        F.when(F.col("event_id") % 101 == 0, "not json").otherwise(body).alias("payload"),
        cents.alias("cents"),
        F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("tenant"), F.col("event_type").cast("binary"))).alias("metadata"),
    )


def events_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of ``events`` without positions."""
    return project_events(table(spark, sf_dir, "events"))


def positioned(feed: DataFrame, bucket_ns: int = HOUR) -> DataFrame:
    """``feed`` with ``pos``: its dense delivery position by (ingest time, id), ranked within ``bucket_ns`` of delivery."""
    return with_position(feed, F.expr(f"ingest_time_ns div {bucket_ns}"), ["ingest_time_ns", "event_id"])


def append_feed(records: DataFrame, path: str) -> None:
    """Write ``records`` as the log at ``path``, each with its position, or add them behind what it holds.

    Positions never change, so they are ranked once, when records arrive, within
    buckets of delivery time that hold about ``BUCKET_ROWS`` records. Files are
    ranges of positions, so that a read of a page opens few.
    """
    spark = records.sparkSession
    before = 0
    if exists(spark, path):
        before = spark.read.parquet(path).agg(F.max("pos")).first()[0] or 0
    n, low, high = records.agg(F.count(F.lit(1)), F.min("ingest_time_ns"), F.max("ingest_time_ns")).first()
    step = max(1, (high - low) // max(1, n // BUCKET_ROWS)) if n else 1
    d = positioned(records, step).withColumn("pos", F.col("pos") + before)
    d.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("append").parquet(path)


def stored_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of ``events`` with positions, written once an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _logs:
        path = new_path(spark, "feed")
        append_feed(events_feed(spark, sf_dir), path)
        _logs[key] = path
    return spark.read.parquet(_logs[key])


#: The same projection in DuckDB, with positions: the head of each oracle.
FEED_SQL = """
feed AS (
  SELECT *, row_number() OVER (ORDER BY ingest_time_ns, event_id) AS pos FROM (
    SELECT event_id, 'k-' || (event_id % 997) AS key, user_id, event_type, epoch_us(ts) * 1000 AS event_time_ns,
      epoch_us(ts) * 1000 + (event_id * 7919 % 13) * 600000000000 AS ingest_time_ns,
      CASE WHEN event_id % 101 = 0 THEN 'not json' ELSE
        '{"customer":"u' || user_id || '","cents":' || CAST(round(value * 100) AS BIGINT) ||
        CASE event_id % 4 WHEN 0 THEN ',"tag":' || (event_id % 7) WHEN 1 THEN ',"tag":"t' || (event_id % 7) || '"' WHEN 2 THEN ',"tag":true' ELSE '' END
        || ',"nested":' || props || '}' END AS payload,
      CAST(round(value * 100) AS BIGINT) AS cents,
      CASE WHEN event_id % 3 = 0 THEN event_type END AS tenant
    FROM events))
"""
