"""Typed secondary indexes over the latest row of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.functions import typed

MAX_ROWS, MAX_PAGE = 1_000, 16 << 20


def latest_by_key(feed: DataFrame, key: str = "key", order: str = "pos") -> DataFrame:
    """The last record of each key: a partial aggregate, so hot keys combine before they meet."""
    row = F.struct(*[F.col(c) for c in feed.columns if c != key])
    return feed.groupBy(key).agg(F.max_by(row, order).alias("__row")).select(key, "__row.*")


def build(feed: DataFrame, fields: dict[str, Column], strict: bool = False, key: str = "key") -> DataFrame:
    """Current rows with typed ``fields``; ``strict`` refuses payloads that are not JSON, else they give nulls."""
    rows = latest_by_key(feed, key)
    if strict:
        bad = F.when(~typed.is_json(F.col("payload")), F.raise_error(F.concat(F.lit("no JSON at "), F.col(key))))
        rows = rows.where(bad.isNull())
    return rows.withColumns(fields)


def _ordered(rows: DataFrame, fields: list[str], limit: int, key: str) -> DataFrame:
    return rows.orderBy(*fields, key).limit(min(limit, MAX_ROWS))


def page(rows: DataFrame, order: list[str], size: Column, max_bytes: int = MAX_PAGE) -> DataFrame:
    """The first of at most ``MAX_ROWS`` ordered rows that together keep within ``max_bytes``, with ``used_bytes``."""
    used = F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.orderBy(*order).limit(MAX_ROWS).withColumn("used_bytes", used).where(F.col("used_bytes") <= max_bytes)


def exact(index: DataFrame, values: dict[str, Column], fields: list[str], limit: int = MAX_ROWS, key: str = "key") -> DataFrame:
    """Rows whose declared ``fields`` all equal ``values``; null equals null."""
    if set(values) != set(fields):
        raise ValueError("an exact lookup names every field")
    for name, value in values.items():
        index = index.where(F.col(name) == value)
    return _ordered(index, fields, limit, key)


def prefix(index: DataFrame, leading: dict[str, Column], fields: list[str], text: tuple[str, str] | None = None, limit: int = MAX_ROWS, key: str = "key") -> DataFrame:
    """Rows equal in the ``leading`` fields and, with ``text``, whose next field is text that starts so."""
    for name, value in leading.items():
        index = index.where(F.col(name) == value)
    if text is not None:
        field, start = text
        index = index.where((F.col(field)["tag"] == typed.TEXT) & F.startswith(F.col(field)["s"], F.lit(start)))
    return _ordered(index, fields, limit, key)


def between(
    index: DataFrame,
    leading: dict[str, Column],
    field: str,
    fields: list[str],
    lower: Column | None = None,
    upper: Column | None = None,
    lower_open: bool = False,
    upper_open: bool = False,
    limit: int = MAX_ROWS,
    key: str = "key",
) -> DataFrame:
    """Rows equal in the leading fields with ``field`` within bounds of the order over all types.

    Without a lower bound, nulls and booleans are within; without an upper one, bytes and text.
    """
    for name, value in leading.items():
        index = index.where(F.col(name) == value)
    if lower is not None:
        index = index.where(F.col(field) > lower if lower_open else F.col(field) >= lower)
    if upper is not None:
        index = index.where(F.col(field) < upper if upper_open else F.col(field) <= upper)
    return _ordered(index, fields, limit, key)


def unique_claims(index: DataFrame, field: str, order: str = "pos") -> DataFrame:
    """Rows with ``conflicted``: the first claimant of a value in feed order holds it; nulls claim nothing.

    For data where no row gives a claim up again. The claimant is a partial
    aggregate joined back, so a value that many rows claim fills no single task.
    """
    first = index.where(F.col(field)["tag"] != typed.NULL).groupBy(field).agg(F.min(order).alias("__first"))
    d = index.join(first, field, "left")
    return d.withColumn("conflicted", F.coalesce(F.col(order) != F.col("__first"), F.lit(False))).drop("__first")


def usage(lookups: DataFrame) -> DataFrame:
    """Lookups of each index by mode, with those cut at the limit and those behind."""
    return lookups.groupBy("index", "mode").agg(
        F.count(F.lit(1)).alias("lookups"), F.sum(F.col("truncated").cast("long")).alias("truncated"), F.sum(F.col("behind").cast("long")).alias("behind")
    )


def postings(index: DataFrame, fields: dict[str, list[str]], key: str = "key") -> DataFrame:
    """(index_name, values, key): an entry a row for each index over its ``fields``."""
    out = None
    for name, own in fields.items():
        values = F.concat_ws("|", *[F.coalesce(typed.shown(F.col(f)), F.lit("-")) for f in own])
        d = index.select(F.lit(name).alias("index_name"), values.alias("values"), key)
        out = d if out is None else out.unionByName(d)
    return out


def resolved(entries: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """The current row of each entry; fails on an entry without one, as a sound index has none."""
    d = entries.join(rows.withColumn("__row", F.lit(True)), key, "left")
    dangling = F.raise_error(F.concat(F.lit("no row for the entry of "), F.col(key))).cast("boolean")
    return d.where(F.when(F.col("__row").isNull(), dangling).otherwise(F.lit(True))).drop("__row")


def posting_gaps(entries: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """Entries without a current row; a sound index has none."""
    return entries.join(rows.select(key), key, "left_anti")


def delete(rows: DataFrame, keys: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(what is left, outcomes): rows and entries of ``keys`` go; ``deleted`` is false for a key that had none."""
    gone = keys.select(key).distinct()
    held = rows.select(key, F.lit(True).alias("deleted")).distinct()
    return rows.join(gone, key, "left_anti"), gone.join(held, key, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def retire(entries: DataFrame, names: list[str]) -> DataFrame:
    """``entries`` without those of the retired indexes; rows and other entries stay."""
    return entries.where(~F.col("index_name").isin(names))


def latest_posting(feed: DataFrame, order: list[str], key: str = "key") -> DataFrame:
    """Every record with whether it is its key's current one: a partial aggregate joined back."""
    last = feed.groupBy(key).agg(F.max(F.struct(*order)).alias("__last"))
    return feed.join(last, key).withColumn("current", F.struct(*order) == F.col("__last")).drop("__last")


def claims_fold(feed: DataFrame, scope: str, value: str, key: str = "key", order: str = "pos") -> DataFrame:
    """(scope, key, value, conflicted) of the current rows where claims are given up again.

    A record claims its value for its key unless another key holds it; either way the
    key gives up what it held before, so a loser holds nothing, and its row stays,
    flagged. Nulls claim nothing; nobody is promoted later. Each scope is folded in
    order by one task from a sorted stream; its memory is the scope's current rows.
    """
    columns = [scope, key, value, order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, holder, kinds = None, {}, {}, None

        def current() -> Iterator[pa.RecordBatch]:
            held = list(rows.items())
            for i in range(0, len(held), 10_000):
                part = held[i : i + 10_000]
                data = [[now] * len(part), [k for k, _ in part], [v for _, (v, _) in part], [c for _, (_, c) in part]]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(data, [*kinds[:3], pa.bool_()])], [*columns[:3], "conflicted"])

        for batch in batches:
            kinds = batch.schema.types
            for s, k, v, _ in zip(*[c.to_pylist() for c in batch.columns]):
                if s != now:
                    yield from current()
                    now, rows, holder = s, {}, {}
                lost = v is not None and holder.get(v, k) != k
                before = rows.get(k)
                if before is not None and holder.get(before[0]) == k:
                    del holder[before[0]]
                if v is not None and not lost:
                    holder[v] = k
                rows[k] = (v, lost)
        if rows:
            yield from current()

    d = feed.select(*columns).where(F.col(scope).isNotNull())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:3])
    return d.repartition(scope).sortWithinPartitions(scope, order).mapInArrow(run, f"{kinds}, conflicted boolean")
