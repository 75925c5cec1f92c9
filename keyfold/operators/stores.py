"""State stores as folds of their mutation journals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ROWS = 1_000


def effective(journal: DataFrame, mutation: str = "mutation_id", order: str = "seq", digest: str = "digest") -> DataFrame:
    """The journal without retries: the first of each mutation id; ``status`` of the others tells repeat from conflict."""
    w = W.partitionBy(mutation).orderBy(order)
    nth, first = F.row_number().over(w), F.first(digest).over(w)
    return journal.withColumn("status", F.when(nth == 1, "applied").when(F.col(digest) == first, "deduplicated").otherwise("conflict"))


def fold(journal: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Current rows of a journal of ``op`` put, delete and clear, without unique keys.

    The latest put or delete of each key after the last clear; deletes leave nothing.
    """
    cleared = journal.where("op = 'clear'").agg(F.max(order).alias("__cleared"))  # one row
    d = journal.where("op <> 'clear'").crossJoin(F.broadcast(cleared)).where(F.col("__cleared").isNull() | (F.col(order) > F.col("__cleared")))
    row = F.struct(*[F.col(c) for c in journal.columns if c != key])
    last = d.groupBy(key).agg(F.max_by(row, order).alias("__row")).select(key, "__row.*")
    return last.where("op = 'put'")


def fold_unique(journal: DataFrame, scope: str, key: str = "key", unique: str = "unique_value", order: str = "seq") -> DataFrame:
    """Current rows where ``unique`` may be held by one key of a ``scope`` at a time.

    A put whose value another key holds does nothing at all; a put that changes
    its value, a delete or a clear gives the old value up. Earlier losers get
    nothing back. Each scope (a store's range, say) is folded in order by one
    task from a sorted stream of batches; its memory is the scope's current rows.
    """
    columns = journal.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        rows: dict = {}
        holder: dict = {}

        def current() -> Iterator[pa.RecordBatch]:
            held = list(rows.values())
            for i in range(0, len(held), 10_000):
                yield pa.RecordBatch.from_pylist(held[i : i + 10_000], schema=kind)

        kind = None
        for batch in batches:
            kind = batch.schema
            for r in batch.to_pylist():
                if now != (r[scope],):
                    yield from current()
                    now, rows, holder = (r[scope],), {}, {}
                if r["op"] == "clear":
                    rows.clear()
                    holder.clear()
                    continue
                k, value = r[key], r[unique]
                if r["op"] == "put" and value is not None and holder.get(value, k) != k:
                    continue
                old = rows.pop(k, None)
                if old is not None and old[unique] is not None:
                    holder.pop(old[unique], None)
                if r["op"] == "put":
                    rows[k] = r
                    if value is not None:
                        holder[value] = k
        yield from current()

    return journal.repartition(scope).sortWithinPartitions(scope, order).mapInArrow(run, journal.schema).select(columns)


def accumulate(rows: DataFrame, deltas: DataFrame, key: list[str]) -> DataFrame:
    """Accumulator rows (count, sum) with ``deltas`` added."""
    return rows.unionByName(deltas).groupBy(*key).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"))


def accumulate_claiming(deltas: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, count, sum, conflicted): what each key adds up to, and whether its claim of ``value`` is another's.

    The first key to name a value holds it; a key that names a held one loses its
    entry, never its sum. A key keeps to one value. Null values claim nothing.
    """
    rows = deltas.groupBy(key, value).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min(order).alias("__first"))
    holder = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min("__first").alias("__holder"))
    d = rows.join(holder, value, "left").withColumn("conflicted", F.coalesce(F.col("__first") != F.col("__holder"), F.lit(False)))
    return d.select(key, value, "count", "sum", "conflicted")


def get_by(store: DataFrame, values: dict[str, Column], limit: int = MAX_ROWS, key: str = "key") -> DataFrame:
    """Rows whose named tuple is exactly ``values``, in key order."""
    for name, value in values.items():
        store = store.where(F.col(name) == value)
    return store.orderBy(key).limit(min(limit, MAX_ROWS))


def get_range(store: DataFrame, name: str, lower: Column, upper: Column, limit: int = MAX_ROWS, key: str = "key") -> DataFrame:
    """Rows with ``name`` from ``lower`` up to, not including, ``upper``, by value then key."""
    return store.where((F.col(name) >= lower) & (F.col(name) < upper)).orderBy(name, key).limit(min(limit, MAX_ROWS))


def iterate(store: DataFrame, after: str | None, limit: int, key: str = "key", pinned: int | None = None) -> DataFrame:
    """A page in key order strictly after ``after``, with ``next_key`` if more rows follow.

    ``pinned`` is the sequence that ``store`` was folded up to, which all pages of one
    iteration share (``pinned_seq``).
    """
    d = store if after is None else store.where(F.col(key) > after)
    page = d.orderBy(key).limit(limit + 1)
    nth = F.row_number().over(W.orderBy(key))  # limit + 1 rows
    page = page.withColumn("__nth", nth)
    more = F.max("__nth").over(W.partitionBy()) > limit
    last = F.max(F.when(F.col("__nth") == limit, F.col(key))).over(W.partitionBy())
    page = page.withColumn("next_key", F.when(more, last)).where(F.col("__nth") <= limit).drop("__nth")
    return page if pinned is None else page.withColumn("pinned_seq", F.lit(pinned).cast("long"))


def up_to(journal: DataFrame, sequence: int, order: str = "seq") -> DataFrame:
    """The journal as it was at ``sequence``."""
    return journal.where(F.col(order) <= sequence)
