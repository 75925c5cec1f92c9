"""The three pipes over bounded feeds: forward, enrich and window.

A window pipe counts or sums per typed group and pane. Checks run in a fixed
order, which decides what a record counts as: group, key cap, lateness, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.functions import typed
from keyfold.functions.ordering import with_running_max
from keyfold.plans.declarations import Miss, WindowPipe

#: What stands in no pane: late records of a group, and what a cap refused under its own name.
SENTINEL = -1
KEY_CAP, BYTE_CAP = "__keycap__", "__bytecap__"
#: Bytes of a stored row beside its group: length, pane and accumulator.
ROW_BYTES = 4 + 8 + 26


def forward(feed: DataFrame, where: Column | None = None) -> DataFrame:
    """Records passed on as they are."""
    return feed if where is None else feed.where(where)


def projected(feed: DataFrame, pipe: WindowPipe) -> DataFrame:
    """Records with a usable group: ``g`` (typed), ``value`` and ``pane``."""
    instant = "event_time_ns" if pipe.clock == "event" else "ingest_time_ns"
    value = typed.json_value(F.col("payload"), pipe.value_path) if pipe.value_path else typed.i64(F.lit(0))
    d = feed.withColumns({"g": typed.json_value(F.col("payload"), pipe.group_path), "value": value})
    return d.where(F.col("g")["tag"] != typed.NULL).withColumn("pane", F.expr(f"greatest({instant}, 0L) div {pipe.pane_ns}L"))


def _folded(d: DataFrame, *more: str) -> DataFrame:
    """(group_tag, group_value, pane, posting, count, sum) of rows with ``g``, ``row_pane`` (-1: sentinel) and ``counted``."""
    return (
        d.groupBy(F.col("g")["tag"].alias("group_tag"), typed.shown(F.col("g")).alias("group_value"), F.col("row_pane").alias("pane"), *more)
        .agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.col("counted").cast("decimal(19,0)")), F.lit(0)).cast("decimal(38,0)").alias("sum"))
        .select("group_tag", "group_value", "pane", F.when(F.col("pane") < 0, SENTINEL).otherwise(0).alias("posting"), *more, "count", "sum")
    )


def admitted_groups(d: DataFrame, limit_keys: int) -> DataFrame:
    """The first ``limit_keys`` (at most 512) groups ``g`` in typed order."""
    return d.select("g").distinct().orderBy("g").limit(limit_keys)


def _within_bytes(d: DataFrame, limit_bytes: int, held: DataFrame | None = None) -> DataFrame:
    """(g, row_pane) of the rows that fit ``limit_bytes`` (at most 256 KiB) in the order they are first seen.

    A row costs its group's bytes and ``ROW_BYTES``; rows ``held`` already cost theirs
    first. Of the rows of one cost no more than ``limit / cost`` can ever fit, and no
    others than the first of them, so the driver goes through a bounded list in one fetch.
    """
    cost = typed.stored_size(F.col("g")) + ROW_BYTES
    rows = d.groupBy("g", "row_pane").agg(F.min("pos").alias("first_pos")).withColumn("cost", cost)
    left, fitting = limit_bytes, []
    if held is not None:
        left -= held.agg(F.sum(cost)).first()[0] or 0
        rows = rows.join(held, ["g", "row_pane"], "left_anti")
    order = ["first_pos", "g", "row_pane"]
    nth = F.row_number().over(W.partitionBy("cost").orderBy(*order))
    seen = rows.withColumn("nth", nth).where(F.col("nth") <= limit_bytes // ROW_BYTES).where(F.col("nth") * F.col("cost") <= limit_bytes)
    for r in seen.orderBy(*order).collect():
        if r["cost"] <= left:
            fitting.append((r["g"], r["row_pane"]))
            left -= r["cost"]
    found = d.sparkSession.createDataFrame(fitting, f"g {typed.TYPE}, row_pane long")
    return found if held is None else found.unionByName(held)


def _refused(d: DataFrame, refused: Column, name: str) -> DataFrame:
    """``d`` with the refused rows under the sentinel group ``name``, counted but not summed."""
    return d.withColumns(
        {
            "g": F.when(refused, typed.text(F.lit(name))).otherwise(F.col("g")),
            "row_pane": F.when(refused, F.lit(SENTINEL).cast("long")).otherwise(F.col("row_pane")),
            "counted": F.when(refused, F.lit(0).cast("long")).otherwise(F.col("counted")),
        }
    )


def window_rows(feed: DataFrame, pipe: WindowPipe, admitted: DataFrame | None = None, horizon_ns: int = 0) -> DataFrame:
    """Each record's ``g``, ``row_pane`` (-1: a sentinel row) and ``counted``; records that count nowhere are left out.

    ``admitted`` names the groups that a key cap lets through; a watermark pipe judges
    lateness by ``horizon_ns``.
    """
    d = projected(feed, pipe)
    late = F.lit(False)
    if pipe.watermark_ns is not None:
        end = (F.col("pane") + 1) * pipe.pane_ns
        late = (end <= horizon_ns) & (F.lit(horizon_ns) > end + pipe.grace_ns)
    elif pipe.clock == "event" and pipe.max_late_ns is not None:
        late = F.col("ingest_time_ns") - F.col("event_time_ns") > pipe.max_late_ns
    usable = F.col("value")["tag"] == typed.I64
    capped = F.lit(False)
    if admitted is not None:
        d = d.join(F.broadcast(admitted.withColumn("__ok", F.lit(True))), "g", "left")
        capped = F.col("__ok").isNull()
    d = d.withColumns({"__late": late & ~capped, "__capped": capped}).where(F.col("__capped") | F.col("__late") | usable)
    d = d.withColumns(
        {
            "row_pane": F.when(F.col("__late"), SENTINEL).otherwise(F.col("pane")).cast("long"),
            "counted": F.when(F.col("__late"), F.lit(0).cast("long")).otherwise(F.col("value")["i"]),
        }
    )
    return _refused(d, F.col("__capped"), KEY_CAP) if admitted is not None else d


def bytes_capped(d: DataFrame, limit_bytes: int, held: DataFrame | None = None) -> DataFrame:
    """:func:`window_rows` with those beyond the byte limit under its sentinel; ``held`` (g, row_pane) are rows there are."""
    fits = _within_bytes(d.where(~F.col("__capped")), limit_bytes, held).withColumn("__fits", F.lit(True))
    d = d.join(F.broadcast(fits), ["g", "row_pane"], "left")
    return _refused(d, F.col("__fits").isNull() & ~F.col("__capped"), BYTE_CAP)


def window(feed: DataFrame, pipe: WindowPipe) -> DataFrame:
    """One fold of the whole feed: pane rows, and sentinel rows (posting -1) for late records and each cap.

    Records are parsed once and meet in one aggregate. A byte limit needs ``pos``,
    as rows are admitted in delivery order.
    """
    admitted = admitted_groups(projected(feed, pipe), pipe.limit_keys) if pipe.limit_keys else None
    d = window_rows(feed, pipe, admitted)
    return _folded(bytes_capped(d, pipe.limit_bytes) if pipe.limit_bytes else d)


def with_bounds(panes: DataFrame, pane_ns: int) -> DataFrame:
    """Pane start, end and the emitted event time (the last instant)."""
    start = F.col("pane") * pane_ns
    return panes.withColumns({"pane_start_ns": start, "pane_end_ns": start + pane_ns, "event_time_ns": start + (pane_ns - 1)})


def disposition(panes: DataFrame, pipe: WindowPipe, now_ns: int, horizon_ns: int | None = None) -> DataFrame:
    """``expire``, ``emit`` or ``keep`` for each row: expiry by the ingest clock comes first, late rows stay."""
    end = F.col("pane_end_ns")
    expired = F.lit(False) if pipe.expire_ns is None else F.lit(now_ns) >= end + pipe.expire_ns
    if pipe.watermark_ns is not None:
        closed = F.lit(horizon_ns or 0) >= end
    else:
        closed = F.lit(now_ns) >= end + (pipe.max_late_ns or 0)
    state = F.when(F.col("posting") != 0, "keep").when(expired, "expire").when(closed, "emit").otherwise("keep")
    return with_bounds(panes, pipe.pane_ns).withColumn("disposition", state)


def _quoted(text: Column) -> Column:
    """``text`` as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def emission_payload(pipe: WindowPipe, store_seq: Column, revision: Column) -> Column:
    """The JSON text of an emitted pane.

    The group keeps its JSON type; instants, sums, averages, the store's sequence and
    the revision are decimal strings; a count has neither sum nor average.
    """
    tag, value = F.col("group_tag"), F.col("group_value")
    group = F.when(tag.isin(typed.BOOL, typed.I64), value).when(tag.isin(typed.TEXT, typed.BYTES), _quoted(value)).otherwise("null")
    null = F.lit("null")

    def string(c: Column) -> Column:
        return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))

    fields = {
        "group": group,
        "pane": F.col("pane").cast("string"),
        "pane_start_ns": string(F.col("pane_start_ns")),
        "pane_end_ns": string(F.col("pane_end_ns")),
        "count": F.col("count").cast("string"),
        "sum": string(F.col("sum")) if pipe.value_path else null,
        "average": string(typed.plain_decimal(average())) if pipe.average else null,
        "store_seq": string(store_seq),
        "revision": string(F.greatest(revision, F.lit(1))),
    }
    parts = [x for name, c in fields.items() for x in (F.lit(f',"{name}":'), c)]
    return F.concat(F.lit("{"), F.lit('"group":'), *parts[1:], F.lit("}"))


def average() -> Column:
    """The mean of a pane's values, as a double."""
    return F.col("sum").cast("double") / F.greatest(F.col("count"), F.lit(1))


def rolling_totals(panes: DataFrame, panes_per_window: int = 16) -> DataFrame:
    """Totals over the last ``panes_per_window`` panes of each group."""
    w = W.partitionBy("group_tag", "group_value").orderBy("pane").rangeBetween(-(panes_per_window - 1), 0)
    d = panes.where("posting = 0")
    return d.withColumns({"rolling_count": F.sum("count").over(w), "rolling_sum": F.sum("sum").over(w)})


def horizons(feed: DataFrame, page_records: int, watermark_ns: int) -> DataFrame:
    """(page, horizon_ns): the largest event time of pages up to each, less the watermark, from zero."""
    pages = feed.groupBy(F.expr(f"(pos - 1) div {page_records}").alias("page")).agg(F.max("event_time_ns").alias("top"))
    pages = with_running_max(pages, F.expr("page div 1024"), ["page"], "top", "running")
    return pages.select("page", F.greatest(F.col("running") - watermark_ns, F.lit(0)).alias("horizon_ns"))


def window_by_watermark(feed: DataFrame, pipe: WindowPipe, page_records: int = 64) -> DataFrame:
    """Emissions of a watermark pipe that reads ``page_records`` at a time.

    A row is judged against the horizon after its own page: late if its pane
    ended before and the grace is over, else folded. A pane is emitted one page
    after the horizon passes its end, then again one page after each page that
    still adds to it; each revision carries only the rows since the last. Panes
    that the horizon never passes are open (revision 0); late rows have posting -1.
    """
    d = projected(feed, pipe).withColumn("page", F.expr(f"(pos - 1) div {page_records}"))
    pages = horizons(feed, page_records, pipe.watermark_ns)
    d = d.join(pages, "page")
    end = (F.col("pane") + 1) * pipe.pane_ns
    late = (end <= F.col("horizon_ns")) & (F.col("horizon_ns") > end + pipe.grace_ns)
    # the page at which the horizon passes a pane's end closes that pane
    reached = pages.groupBy(F.expr(f"horizon_ns div {pipe.pane_ns}L").alias("reached")).agg(F.min("page").alias("closing_page"))
    before = F.lag("reached", 1, 0).over(W.orderBy("reached"))  # a row a pane
    closings = reached.withColumn("before", before).where("reached > before")
    closings = closings.select("closing_page", F.explode(F.sequence("before", F.col("reached") - 1)).alias("pane"))
    usable = F.col("value")["tag"] == typed.I64
    kept = d.where(~late & usable).join(closings, "pane", "left")
    kept = kept.withColumn("emit_page", F.greatest("page", "closing_page") + 1).withColumn("emit_page", F.when(F.col("closing_page").isNotNull(), F.col("emit_page")))
    rows = kept.groupBy(F.col("g")["tag"].alias("group_tag"), typed.shown(F.col("g")).alias("group_value"), "pane", "emit_page").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col("value")["i"].cast("decimal(19,0)")).cast("decimal(38,0)").alias("sum")
    )
    revision = F.row_number().over(W.partitionBy("group_tag", "group_value", "pane").orderBy(F.col("emit_page").asc_nulls_last()))
    rows = rows.withColumn("revision", F.when(F.col("emit_page").isNull(), 0).otherwise(revision)).withColumn("posting", F.lit(0))
    late_rows = _folded(d.where(late).withColumns({"row_pane": F.lit(SENTINEL).cast("long"), "counted": F.lit(0).cast("long")}))
    late_rows = late_rows.withColumns({"emit_page": F.lit(None).cast("long"), "revision": F.lit(0)})
    return rows.unionByName(late_rows)


def pane_totals(revisions: DataFrame) -> DataFrame:
    """The whole of each pane: the sum over its revisions."""
    return revisions.where("posting = 0").groupBy("group_tag", "group_value", "pane").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"))


def enrich(feed: DataFrame, store: DataFrame, lookup: Column, miss: Miss = Miss.FORWARD, applied_sequence: int = 0) -> DataFrame:
    """``feed`` with the store row of its lookup key: ``matched``, ``enrich_payload``, ``enrich_seq``.

    ``store`` holds unique ``store_key``s with ``store_payload`` (and ``store_seq``).
    Spark broadcasts the store only if its size allows. A null key never matches;
    an empty payload is left out.
    """
    d = feed.withColumn("__key", lookup).join(store, F.col("__key") == F.col("store_key"), "left")
    matched = F.col("store_key").isNotNull()
    d = d.withColumns(
        {
            "matched": matched,
            "enrich_payload": F.when(F.length("store_payload") > 0, F.col("store_payload")),
            "enrich_seq": F.when(matched, F.lit(applied_sequence).cast("long")).otherwise(F.lit(0).cast("long")),
        }
    ).drop("__key", *store.columns)
    if miss is Miss.DROP:
        return d.where("matched")
    return d.withColumn("quarantine", ~F.col("matched")) if miss is Miss.QUARANTINE else d


def enriched_records(feed: DataFrame, store: DataFrame, lookup: Column, miss: Miss = Miss.FORWARD, applied_sequence: int = 0) -> DataFrame:
    """``feed`` with the outcome of :func:`enrich` in each record's ``metadata``; key and payload stay as they are.

    ``enrich.matched`` and ``enrich.seq`` always, ``enrich.payload`` if it is not
    empty, ``enrich.quarantine`` on misses under QUARANTINE; entries of these names
    that a record brings along are replaced, all others kept. ``to_quarantine`` tells
    where a record goes.
    """
    quarantine = F.lit(miss is Miss.QUARANTINE) & ~F.col("matched")
    d = enrich(feed, store, lookup, miss, applied_sequence).withColumn("to_quarantine", quarantine)
    own = {
        "enrich.quarantine": F.when(F.col("to_quarantine"), "true"),
        "enrich.matched": F.col("matched").cast("string"),
        "enrich.seq": F.col("enrich_seq").cast("string"),
        "enrich.payload": F.col("enrich_payload"),
    }
    entries = [F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in own.items()]
    before = F.coalesce(F.map_entries("metadata"), F.array().cast("array<struct<key:string,value:binary>>"))
    kept = F.filter(before, lambda e: ~e["key"].isin(*own))
    added = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return d.withColumn("metadata", F.map_from_entries(F.concat(kept, added))).drop("matched", "enrich_payload", "enrich_seq", "quarantine")


def strict_store(store: DataFrame, committed_sequence: int, applied_sequence: int) -> DataFrame:
    """``store`` for a strict read: refused while it is behind what is committed."""
    if applied_sequence < committed_sequence:
        raise RuntimeError(f"the store has applied {applied_sequence} of {committed_sequence} committed changes")
    return store


def by_named_key(store: DataFrame, named: str) -> DataFrame:
    """``store`` keyed by a secondary key; of several rows the smallest key wins."""
    return store.groupBy(F.col(named).alias("store_key")).agg(F.min_by("store_payload", "store_key").alias("store_payload"))
