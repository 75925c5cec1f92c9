"""Feeds as streams: idempotent append, enrichment and copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyfold.operators.pipes import enrich
from keyfold.plans.declarations import Miss


def deduplicated(records: DataFrame, scope: list[str], event_time_ns: str, within: str) -> DataFrame:
    """The first record of each ``scope``; retries within the delay are dropped and state is bounded by it."""
    timed = records.withColumn("__t", F.timestamp_micros(F.expr(f"{event_time_ns} div 1000")))
    return timed.withWatermark("__t", within).dropDuplicatesWithinWatermark(scope).drop("__t")


def enriched(records: DataFrame, store: DataFrame, lookup: Column, miss: Miss = Miss.FORWARD) -> DataFrame:
    """A stream-static join: each micro-batch sees the store as it is then."""
    return enrich(records, store, lookup, miss)


def enrich_with_quarantine(records: DataFrame, store: DataFrame, lookup: Column, out: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Matches to one table, misses to another, by batch; a repeated batch overwrites its own files."""

    def split(batch: DataFrame, batch_id: int) -> None:
        d = enrich(batch, store, lookup, Miss.QUARANTINE).persist()
        d.where("not quarantine").drop("quarantine").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        d.where("quarantine").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        d.unpersist()

    return records.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def copy_feed(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """An effectively-once copy: each batch owns one folder of the target."""

    def copy(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return records.writeStream.foreachBatch(copy).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
