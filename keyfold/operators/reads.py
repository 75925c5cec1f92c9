"""Reads, searches and append outcomes over positioned feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_READ, MAX_SCAN = 10_000, 10_000


def read_after(feed: DataFrame, after: int = 0, limit: int = MAX_READ) -> DataFrame:
    """The next ``limit`` records strictly after a position."""
    return feed.where(F.col("pos") > after).orderBy("pos").limit(max(1, min(limit, MAX_READ)))


def read_from_event_time(feed: DataFrame, threshold_ns: int, limit: int = MAX_READ) -> DataFrame:
    """Records at or after an event time, in delivery order."""
    return feed.where(F.col("event_time_ns") >= threshold_ns).orderBy("pos").limit(max(1, min(limit, MAX_READ)))


def tail(feed: DataFrame, n: int) -> DataFrame:
    """The last ``n`` records in delivery order."""
    return feed.orderBy(F.desc("pos")).limit(n).orderBy("pos")


def new_only(feed: DataFrame) -> DataFrame:
    """One row: the end position, after which only new records follow."""
    return feed.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("after_pos"))


def lookup(feed: DataFrame, positions: DataFrame) -> DataFrame:
    """The record of each of ``positions`` (column ``pos``); fails if a position names none."""
    known = feed.withColumn("__known", F.lit(True))
    d = positions.select("pos").distinct().join(known, "pos", "left")
    unknown = F.raise_error(F.concat(F.lit("no record at position "), F.col("pos").cast("string")))
    return d.where(F.when(F.col("__known").isNull(), unknown.cast("boolean")).otherwise(F.lit(True))).drop("__known")


def read_within_bytes(feed: DataFrame, after: int, limit: int, max_bytes: int) -> DataFrame:
    """The longest run after ``after`` of at most ``limit`` records and ``max_bytes`` of payload.

    At most ``limit`` rows take part in the running sum. Fails if the first record is
    over the budget by itself, as reading on could never get past it.
    """
    page = read_after(feed, after, limit)
    w = W.orderBy("pos")
    used = F.sum(F.octet_length("payload")).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = page.withColumns({"used_bytes": used, "__nth": F.row_number().over(w)})
    too_large = F.raise_error(F.lit(f"the first record is over {max_bytes} bytes")).cast("boolean")
    over = F.col("used_bytes") > max_bytes
    return d.where(F.when(over & (F.col("__nth") == 1), too_large).otherwise(~over)).drop("__nth")


def search(
    feed: DataFrame,
    after: int = 0,
    key: str | None = None,
    from_ns: int | None = None,
    to_ns: int | None = None,
    metadata_key: str | None = None,
    metadata_value: bytes | None = None,
    max_scan: int = MAX_SCAN,
) -> DataFrame:
    """Matches among the next ``max_scan`` records; every predicate given must hold."""
    tests: list[Column] = []
    if key is not None:
        tests.append(F.col("key") == key)
    if from_ns is not None:
        tests.append(F.col("event_time_ns") >= from_ns)
    if to_ns is not None:
        tests.append(F.col("event_time_ns") <= to_ns)
    if metadata_key is not None:
        value = F.try_element_at("metadata", F.lit(metadata_key))
        tests.append(value.isNotNull() if metadata_value is None else value == F.lit(metadata_value))
    if not tests:
        raise ValueError("a search needs a predicate")
    scanned = feed.where((F.col("pos") > after) & (F.col("pos") <= after + max_scan))
    for test in tests:
        scanned = scanned.where(test)
    return scanned


def search_progress(feed: DataFrame, after: int = 0, max_scan: int = MAX_SCAN) -> DataFrame:
    """One row: how many records a search from ``after`` goes through, and where the next one starts if any are left."""
    inside = (F.col("pos") > after) & (F.col("pos") <= after + max_scan)
    d = feed.where(F.col("pos") > after).agg(F.count_if(inside).alias("scanned"), F.max("pos").alias("__end"))
    exhausted = F.coalesce(F.col("__end") <= after + max_scan, F.lit(True))
    return d.select("scanned", exhausted.alias("exhausted"), F.when(~exhausted, F.lit(after + max_scan)).cast("long").alias("next_after"))


def append_outcomes(attempts: DataFrame, scope: list[str], order: str, digest: str, key: str | None = None) -> DataFrame:
    """What an idempotent log does with each attempt of a ``scope`` (producer and sequence, or session and request id).

    The first attempt is accepted; later ones with its digest are deduplicated
    to it, others conflict. With ``key``, attempts without one are refused and
    decide nothing for later ones.
    """
    if key is not None:
        empty = F.coalesce(F.octet_length(key) == 0, F.lit(True))
        rest = append_outcomes(attempts.where(~empty), scope, order, digest)
        refused = attempts.where(empty).withColumns({"outcome": F.lit("refused"), "accepted_at": F.lit(None).cast(attempts.schema[order].dataType)})
        return rest.unionByName(refused)
    w = W.partitionBy(*scope).orderBy(order)
    first = F.first(digest).over(w)
    nth = F.row_number().over(w)
    outcome = F.when(nth == 1, "accepted").when(F.col(digest) == first, "deduplicated").otherwise("conflict")
    return attempts.withColumns({"outcome": outcome, "accepted_at": F.first(order).over(w)})


def classify_sequences(attempts: DataFrame, producer: str, order: str, sequence: str) -> DataFrame:
    """Each attempt against the highest sequence its producer has sent before: next, repeat, stale or gap."""
    top = F.max(sequence).over(W.partitionBy(producer).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    d = attempts.withColumn("last_sequence", top)
    expected = F.coalesce(F.col("last_sequence") + 1, F.lit(0))
    s = F.col(sequence)
    kind = F.when(s == expected, "next").when(s > expected, "gap").when(s == F.col("last_sequence"), "repeat").otherwise("stale")
    return d.withColumn("kind", kind)


def feed_stats(feed: DataFrame, by: list[str]) -> DataFrame:
    """Records, payload bytes and the ends of each feed."""
    return feed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.octet_length("payload").cast("long")).alias("bytes"),
        F.min("ingest_time_ns").alias("first_ingest_ns"),
        F.max("ingest_time_ns").alias("last_ingest_ns"),
    )


def matches_pattern(name: Column, pattern: str) -> Column:
    """``*`` is every name, ``x.*`` the descendants of x, anything else that name."""
    if pattern == "*":
        return F.lit(True)
    return F.startswith(name, F.lit(pattern[:-1])) if pattern.endswith(".*") else name == pattern
