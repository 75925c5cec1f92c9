"""Work division of shared subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.functions.typed import key_token, work_window

WINDOWS = 256


def start_at(feed: DataFrame, threshold_ns: int) -> DataFrame:
    """One row: the position after which reading starts so that the first record is at or past an ingest time."""
    return feed.where(F.col("ingest_time_ns") < threshold_ns).agg(F.coalesce(F.max("pos"), F.lit(0)).alias("after_pos"))


def start(feed: DataFrame, at: str, value: int | None = None) -> DataFrame:
    """One row ``after_pos`` for a start at BEGINNING, NOW, a TIMESTAMP of the ingest clock or after a CURSOR.

    A cursor that names no record is refused.
    """
    if at == "BEGINNING":
        return feed.sparkSession.createDataFrame([(0,)], "after_pos long")
    if at == "NOW":
        return feed.agg(F.coalesce(F.max("pos"), F.lit(0)).cast("long").alias("after_pos"))
    if at == "TIMESTAMP":
        return start_at(feed, value)
    if at == "CURSOR":
        found = feed.where(F.col("pos") == value).agg(F.max("pos").alias("after_pos"))
        return found.select(F.coalesce("after_pos", F.raise_error(F.lit(f"no record at position {value}")).cast("long")).alias("after_pos"))
    raise ValueError(f"no such start: {at}")


def fetch(feed: DataFrame, covered: DataFrame, delivered: DataFrame, deferred: DataFrame, limit: int, key: str = "key") -> DataFrame:
    """The next ``limit`` records for a member: those deferred to it before come first, then new ones of its windows.

    ``delivered`` and ``deferred`` hold positions; a deferred record is due once its
    window is covered, whatever was delivered after it.
    """
    d = divided(feed, covered, key).where("deliver").join(delivered.select("pos"), "pos", "left_anti")
    back = deferred.select("pos", F.lit(0).alias("__turn")).distinct()
    d = d.join(back, "pos", "left").withColumn("redelivered", F.col("__turn").isNotNull())
    return d.orderBy(F.desc("redelivered"), "pos").limit(limit).drop("__turn", "deliver")


def delayed(feed: DataFrame, now_ns: int, delay_ns: int, key: str = "key") -> DataFrame:
    """Records old enough to deliver; none overtakes an earlier parked record of its key."""
    parked = F.col("ingest_time_ns") > now_ns - delay_ns
    blocked = feed.where(parked).groupBy(key).agg(F.min("pos").alias("__first_parked"))
    d = feed.where(~parked).join(blocked, key, "left")
    return d.where(F.col("__first_parked").isNull() | (F.col("pos") < F.col("__first_parked"))).drop("__first_parked")


def coverage(leases: DataFrame) -> DataFrame:
    """(window, work_id) of all 256 windows: pinned ones to their lease, the others round-robin over live leases.

    ``leases`` (work_id, live, pinned array<int>) has at most 256 rows.
    """
    live = leases.where("live").withColumn("nth", F.row_number().over(W.orderBy("work_id")) - 1)
    total = live.agg(F.count(F.lit(1)).alias("n"))
    pinned = live.select(F.explode("pinned").alias("window"), "work_id").groupBy("window").agg(F.min("work_id").alias("pinned_to"))
    windows = leases.sparkSession.range(WINDOWS).select(F.col("id").cast("int").alias("window"))
    d = windows.crossJoin(F.broadcast(total)).join(pinned, "window", "left")
    turn = F.when(F.col("n") > 0, F.col("window") % F.col("n"))
    d = d.withColumn("nth", turn.cast("int")).join(live.select("nth", F.col("work_id").alias("turn_of")), "nth", "left")
    return d.select("window", F.coalesce("pinned_to", "turn_of").alias("work_id"))


def divided(feed: DataFrame, covered: DataFrame, key: str = "key") -> DataFrame:
    """``feed`` with its ``window`` and ``deliver``: whether that window is among ``covered`` (at most 256 rows)."""
    d = feed.withColumn("window", work_window(F.col(key)))
    return d.join(F.broadcast(covered.select("window", F.lit(True).alias("__c"))), "window", "left").withColumn("deliver", F.coalesce("__c", F.lit(False))).drop("__c")


def attempts_left(work: DataFrame, max_attempts: int, then: str) -> DataFrame:
    """``retry`` or, past the budget, ``then`` (quarantine or skip)."""
    return work.withColumn("action", F.when(F.col("attempts") > max_attempts, F.lit(then)).otherwise("retry"))


def split_frontier(acknowledged: DataFrame, token: str, key: str = "key") -> DataFrame:
    """(side, frontier): the last acknowledged position on each side of a split at ``token``."""
    side = F.when(key_token(F.col(key)) < token, "left").otherwise("right")
    return acknowledged.groupBy(side.alias("side")).agg(F.max("pos").alias("frontier"))


def merge_frontier(records: DataFrame, acknowledged: Column) -> DataFrame:
    """One row: the last position before the first unacknowledged record in merged order."""
    first = F.min(F.when(~acknowledged, F.col("pos")))
    return records.agg((F.coalesce(first, F.max("pos") + 1) - 1).alias("frontier"))


def set_changes(sets: DataFrame) -> DataFrame:
    """Position sets after additions and removals (array columns ``held``, ``added``, ``removed``)."""
    return sets.withColumn("held", F.sort_array(F.array_except(F.array_union("held", "added"), "removed")))


def union_of_feeds(feeds: dict[str, DataFrame]) -> DataFrame:
    """The member feeds of a domain with their names; order holds within each only."""
    out = None
    for name, feed in feeds.items():
        own = feed.withColumn("feed", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out
