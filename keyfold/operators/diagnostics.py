"""Findings about a running system, stage by stage, and what to do about them first.

A rule turns evidence into findings (stage, resource, severity, reason); stages and
recommendations are aggregates over the union of all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEVERITY = ["healthy", "advisory", "limited", "degraded", "unhealthy"]
STAGES = ["control plane", "nodes", "storage", "writers", "readers", "subscriptions", "pipes", "copies", "indexes"]
#: A copy's report is stale after this long; a range needs so many nodes that may hold it.
STALE_MS, REPLICAS = 60_000, 3


def _findings(d: DataFrame, stage: str, resource: str | Column, *cases: tuple[Column, str, str | Column]) -> DataFrame:
    """The first of ``cases`` (condition, severity, reason) that holds for each row."""
    out = None
    for when, severity, reason in cases:
        found = F.struct(F.lit(severity).alias("severity"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
        out = F.when(when, found) if out is None else out.when(when, found)
    name = F.col(resource) if isinstance(resource, str) else resource
    d = d.select(F.lit(stage).alias("stage"), name.cast("string").alias("resource"), out.alias("f")).where("f is not null")
    return d.select("stage", "resource", "f.*")


def control_plane(evidence: DataFrame) -> DataFrame:
    """``evidence`` (node, replicated, leader): no replicated control plane is advisory, one without a leader unhealthy."""
    return _findings(
        evidence, "control plane", "node",
        (~F.col("replicated"), "advisory", "not replicated"),
        (F.col("leader").isNull(), "unhealthy", "no leader"),
    )


def nodes(members: DataFrame, timeout_ms: int) -> DataFrame:
    """``members`` (node, local, last_seen_age_ms): others that were not heard of for longer than the timeout are degraded."""
    silent = ~F.col("local") & (F.col("last_seen_age_ms") > timeout_ms)
    return _findings(members, "nodes", "node", (silent, "degraded", "silent"))


def storage(pool: DataFrame) -> DataFrame:
    """``pool`` (node, eligible, exclusions): what keeps nodes from taking ranges, and a pool with too few that may."""
    each = pool.select("node", F.explode("exclusions").alias("exclusion"))
    planned = F.col("exclusion").isin("draining", "retired")
    own = _findings(each, "storage", "node", (planned, "advisory", F.col("exclusion")), (F.lit(True), "degraded", F.col("exclusion")))
    counts = pool.agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("eligible"))
    few = (F.col("n") > 0) & (F.col("eligible") < REPLICAS)
    return own.unionByName(_findings(counts, "storage", F.lit("storage pool"), (few, "unhealthy", "too few eligible nodes")))


def writers(hot_keys: DataFrame) -> DataFrame:
    """``hot_keys`` (feed, range, share_bps): one key holds much of a range."""
    return _findings(hot_keys, "writers", F.coalesce("feed", F.concat(F.lit("range "), "range")), (F.lit(True), "advisory", "hot key"))


def readers(reports: DataFrame) -> DataFrame:
    """``reports`` (reader, last_retry_after_ms): the last delivery was held back."""
    return _findings(reports, "readers", "reader", (F.col("last_retry_after_ms") > 0, "degraded", "paced"))


def _owner_cases() -> tuple:
    """Owners that are dead, or of whom nobody can tell (a null ``alive`` or no row of theirs)."""
    owned = F.col("owner").isNotNull()
    return (owned & (F.col("alive") == F.lit(False)), "degraded", "owner dead"), (owned & F.col("alive").isNull(), "advisory", "owner unknown")


def subscriptions(owners: DataFrame, live: DataFrame) -> DataFrame:
    """``owners`` (subscription, owner): progress that nobody owns, or whose owner is dead or unknown by ``live`` (owner, alive)."""
    d = owners.join(live, "owner", "left")
    return _findings(d, "subscriptions", "subscription", (F.col("owner").isNull(), "degraded", "no owner"), *_owner_cases())


def pipes(owners: DataFrame, live: DataFrame) -> DataFrame:
    """``owners`` (pipe, owner, paused): paused pipes, and owners that are dead or unknown by ``live``; both may hold."""
    paused = _findings(owners, "pipes", "pipe", (F.col("paused"), "advisory", "paused"))
    return paused.unionByName(_findings(owners.join(live, "owner", "left"), "pipes", "pipe", *_owner_cases()))


def copies(reports: DataFrame) -> DataFrame:
    """``reports`` (copy, state, report_age_ms): stalled copies and stale reports; both may hold."""
    stalled = _findings(reports, "copies", "copy", (F.col("state") == "stalled", "degraded", "stalled"))
    return stalled.unionByName(_findings(reports, "copies", "copy", (F.col("report_age_ms") > STALE_MS, "degraded", "report stale")))


def indexes(builds: DataFrame) -> DataFrame:
    """``builds`` (index, state): a new generation is being built."""
    return _findings(builds, "indexes", "index", (F.col("state") == "building", "advisory", "building"))


def severity_rank(name: str) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), F.col(name)) - 1


def explain(findings: DataFrame, stages: list[str] = STAGES, per_stage: int = 64) -> DataFrame:
    """(stage_order, stage, status, findings): a stage is as bad as its worst finding; stages without findings are healthy.

    A control plane that is not replicated is limited, though its finding is advisory.
    """
    listed = findings.sparkSession.createDataFrame([(i, s) for i, s in enumerate(stages)], "stage_order int, stage string")
    rank = severity_rank("severity")
    if "reason" in findings.columns:
        limited = (F.col("stage") == "control plane") & (F.col("reason") == "not replicated")
        rank = F.greatest(rank, F.when(limited, SEVERITY.index("limited")).otherwise(0))
    worst = findings.groupBy("stage").agg(F.max(rank).alias("__w"), F.least(F.count(F.lit(1)), F.lit(per_stage)).alias("findings"))
    names = F.array(*[F.lit(x) for x in SEVERITY])
    d = listed.join(worst, "stage", "left")
    return d.select("stage_order", "stage", F.get(names, F.coalesce("__w", F.lit(0)).cast("int")).alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"))


def recommend(findings: DataFrame, k: int = 16, stages: list[str] = STAGES) -> DataFrame:
    """The ``k`` gravest findings, ranked by severity, then stage order, resource and reason."""
    place = F.array_position(F.array(*[F.lit(x) for x in stages]), F.col("stage"))
    order = [F.desc("__s"), F.col("__p"), F.col("resource"), F.col("reason")]
    top = findings.withColumns({"__s": severity_rank("severity"), "__p": place}).orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order))).drop("__s", "__p")  # k rows


def scoped_signals(signals: DataFrame, feed: str, domain: str, now_ns: int, look_back_ns: int = 24 * 3600 * 10**9, cap: int = 128) -> DataFrame:
    """The latest ``cap`` signals of a feed's scope (feed before domain before node) with how many more there were.

    Undated signals are kept; the cap is the report's length.
    """
    rank = F.when(F.col("scope") == f"feed:{feed}", 0).when(F.col("scope") == f"domain:{domain}", 1).when(F.startswith("scope", F.lit("node:")), 2)
    d = signals.withColumn("scope_rank", rank).where("scope_rank is not null")
    d = d.where(F.col("at_ns").isNull() | (F.col("at_ns") >= now_ns - look_back_ns))
    total = d.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("truncated"))
    top = d.orderBy("scope_rank", F.desc_nulls_last("at_ns"), "signal_id").limit(cap)
    return top.crossJoin(F.broadcast(total))
