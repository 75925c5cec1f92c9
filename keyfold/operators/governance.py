"""Retention, policy inheritance and access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def retention(segments: DataFrame, now_ns: int, expire_ns: int | None, max_bytes: int | None, holds: DataFrame | None = None) -> DataFrame:
    """Segments to delete: the unbroken run of oldest ones of each feed that expired or exceed its byte budget.

    ``segments``: (feed, seq, bytes, last_ingest_ns). Feeds among ``holds`` keep all.
    With a column ``floor_seq``, segments below it are gone already and count for nothing.
    """
    if holds is not None:
        segments = segments.join(holds.select("feed").distinct(), "feed", "left_anti")
    if "floor_seq" in segments.columns:
        segments = segments.where(F.col("floor_seq").isNull() | (F.col("seq") >= F.col("floor_seq")))
    w = W.partitionBy("feed")
    rest = F.sum("bytes").over(w.orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, 0))
    expired = F.lit(False) if expire_ns is None else F.col("last_ingest_ns") + expire_ns < now_ns
    over = F.lit(False) if max_bytes is None else F.col("__rest") > max_bytes
    d = segments.withColumn("__rest", rest).withColumn("__goes", expired | over)
    keeper = F.min(F.when(~F.col("__goes"), F.col("seq"))).over(w)
    return d.withColumn("__keeper", keeper).where(F.col("__keeper").isNull() | (F.col("seq") < F.col("__keeper"))).drop("__rest", "__goes", "__keeper")


def sweep(segments: DataFrame, now_ns: int, expire_ns: int | None, max_bytes: int | None, holds: DataFrame, erased: DataFrame) -> DataFrame:
    """(feed, seq, cause) of every segment to destroy: a hold freezes a feed, an erased one goes whole, the rest as :func:`retention` says."""
    free = segments.join(holds.select("feed").distinct(), "feed", "left_anti")
    gone = erased.select("feed").distinct()
    purged = free.join(gone, "feed", "left_semi").select("feed", "seq", F.lit("erased").alias("cause"))
    rest = retention(free.join(gone, "feed", "left_anti"), now_ns, expire_ns, max_bytes)
    return purged.unionByName(rest.select("feed", "seq", F.lit("retention").alias("cause")))


def effective_policy(feeds: DataFrame, domains: DataFrame, fields: list[str]) -> DataFrame:
    """Each feed's policy: its own field, else that of its longest matching domain.

    A feed ``a.b.c`` may belong to ``a.b`` or ``a``: every prefix is looked up by equality.
    """
    parts = F.split("feed", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    candidates = feeds.select("feed", F.explode(prefixes).alias("domain")).join(domains, "domain")
    own = candidates.groupBy("feed").agg(F.max_by(F.struct("domain", *fields), F.length("domain")).alias("__d"))
    d = feeds.join(own, "feed", "left")
    return d.select("feed", F.col("__d")["domain"].alias("domain"), *[F.coalesce(F.col(f), F.col("__d")[f]).alias(f) for f in fields])


def access(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """``allowed`` for each (principal, action, resource): denied by default, a covering deny beats an allow.

    A grant covers its resource and all below; manage includes read and write,
    and a deny of manage denies all three.
    """
    parts = F.split("resource", r"\.")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.when(i == 0, "*").otherwise(F.array_join(F.slice(parts, 1, F.greatest(i, F.lit(1))), ".")))
    asked = requests.withColumn("scope", F.explode(above)).withColumn("granted", F.explode(F.array_distinct(F.array("action", F.lit("manage")))))
    g = grants.select("principal", F.col("action").alias("granted"), F.col("resource").alias("scope"), "effect")
    hits = asked.join(g, ["principal", "granted", "scope"], "left")
    return hits.groupBy(*requests.columns).agg(
        (F.coalesce(F.bool_or(F.col("effect") == "allow"), F.lit(False)) & ~F.coalesce(F.bool_or(F.col("effect") == "deny"), F.lit(False))).alias("allowed")
    )


def tier_of(segments: DataFrame, now_ns: int, tier_after_ns: int) -> DataFrame:
    """Where each segment stands: open ones stay, sealed ones move once older than the delay."""
    old = F.col("last_ingest_ns") + tier_after_ns <= now_ns
    return segments.withColumn("tier", F.when(~F.col("sealed"), "open").when(old, "move").otherwise("deferred"))


def copy_lag(source: DataFrame, copied: DataFrame, key: list[str], stalled_after: int) -> DataFrame:
    """(feed, lag, state): records of the source that the copy lacks."""
    missing = source.join(copied.select(*key), key, "left_anti").groupBy("feed").agg(F.count(F.lit(1)).alias("missing"))
    d = source.select("feed").distinct().join(missing, "feed", "left").withColumn("lag", F.coalesce("missing", F.lit(0)))
    state = F.when(F.col("lag") == 0, "current").when(F.col("lag") > stalled_after, "stalled").otherwise("behind")
    return d.select("feed", "lag", state.alias("state"))


def source_block(names: DataFrame) -> DataFrame:
    """A feed's short name (last segment) beside its full name."""
    return names.withColumn("short_name", F.element_at(F.split("feed", r"\."), -1))
