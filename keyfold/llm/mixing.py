"""Pfair mixing: sources are interleaved block by block at their target weights.

Every source has an integer share; a period has as many slots as the shares sum
to. Block j of a source with weight w = share / period is released at
floor(j / w) and due by ceil((j + 1) / w). Earliest-deadline-first over the
released blocks fills one period; the pattern repeats, so a block's slot and a
document's position follow in closed form from its rank in its source. While
every source still has blocks, each is less than one block away from its exact
share at every slot. A source that runs out leaves its slots empty and the
others close up, so every document keeps exactly one position.

Within a source, documents are ordered by the MD5 of their id, then by id. The
rank is a count over hash-prefix buckets plus a rank inside the bucket, so no
task holds a whole source.

Defined results: a null source is a source of its own (share ``default_share``);
null ids come last in their bucket; repeated rows each get a position of their
own, in any order among equals; of two blocks with one deadline the earlier released
goes first, then the source that sorts first; texts are carried, whatever they are; an
empty table gives an empty result; other columns are carried along
unless ``columns`` names those to keep, and one of an added column's name is
replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.functions.ordering import with_position

#: Slots times sources up to which the template is part of the expressions; beyond, it is a table.
MAX_CELLS = 200_000
#: Sources and slots of a period that the driver schedules.
MAX_SOURCES, MAX_PERIOD = 100_000, 1_000_000
#: Documents of a source in one hash-prefix bucket, about; the prefix has one to eight digits.
BUCKET_DOCS = 500
ADDED = ("mix_slot", "mix_position", "mix_on_target")


def edf_template(shares: list[int]) -> list[int]:
    """The source index of every slot of one period, earliest deadline first (ties: earlier release, lower index)."""
    period = sum(shares)
    waiting = [(0, i, 0) for i in range(len(shares))]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    slots = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // shares[i]), release, i, j))
        _, _, i, j = heapq.heappop(ready)
        slots.append(i)
        if j + 1 < shares[i]:
            heapq.heappush(waiting, ((j + 1) * period // shares[i], i, j + 1))
    return slots


def _sources(docs: DataFrame, source_col: str) -> list[str | None]:
    found = docs.select(source_col).distinct().limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = [row[0] for row in found]
    return sorted([x for x in names if x is not None]) + [None] * (None in names)


def _ranked(d: DataFrame, largest: int) -> DataFrame:
    """``d`` (__src, __h, __id) with ``__rank`` from 0 in its source: rows in earlier hash buckets and those before in its own."""
    digits, room = 1, 16 * BUCKET_DOCS
    while room < largest and digits < 8:
        digits, room = digits + 1, room * 16
    d = d.withColumn("__p", F.substring("__h", 1, digits))
    counts = d.groupBy("__src", "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("__src").orderBy("__p").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    counts = counts.select("__src", "__p", before.alias("__before"))  # a row a bucket
    inside = F.row_number().over(W.partitionBy("__src", "__p").orderBy("__h", F.col("__id").asc_nulls_last()))
    d = d.withColumn("__in", inside).join(counts, ["__src", "__p"])
    return d.withColumn("__rank", F.col("__before") + F.col("__in") - 1).drop("__before", "__in", "__p")


def _carried(docs: DataFrame, columns: list[str] | None, id_col: str) -> list[Column]:
    """The kept input row as one struct, and what ranks are made of."""
    kept = [c for c in columns or docs.columns if c not in ADDED]
    digest = F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("~"))
    return [F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), digest.alias("__h"), F.col(id_col).alias("__id")]


def _by_tables(docs: DataFrame, names: list, k: list[int], slots: list[int], block_docs: int, id_col: str, source_col: str, columns: list[str] | None) -> DataFrame:
    """:func:`mix` for many sources or long periods: the template is joined, positions are counted along the slots."""
    spark, period = docs.sparkSession, len(slots)
    nth: list[int] = [0] * len(k)
    rows = []
    for t, i in enumerate(slots):
        rows.append((i, nth[i], t))
        nth[i] += 1
    template = spark.createDataFrame(rows, "__src int, __nth long, __t long")
    sources = spark.createDataFrame([(i, name, share) for i, (name, share) in enumerate(zip(names, k))], "__src int, __name string, __k long")
    d = docs.select(*_carried(docs, columns, id_col), F.col(source_col).alias("__name"))
    d = d.join(sources, d["__name"].eqNullSafe(sources["__name"])).drop("__name")
    sizes = d.groupBy("__src", "__k").agg(F.count(F.lit(1)).alias("__n"))
    largest = sizes.agg(F.max("__n")).first()[0]
    d = _ranked(d, largest).withColumn("__block", F.expr(f"__rank div {block_docs}"))
    d = d.withColumn("__nth", F.col("__block") % F.col("__k")).join(template, ["__src", "__nth"])
    d = d.withColumn("mix_slot", F.expr(f"__block div __k * {period}") + F.col("__t"))
    # the first slot that finds its source exhausted
    ends = sizes.withColumn("__b", F.ceil(F.col("__n") / block_docs)).withColumn("__nth", F.col("__b") % F.col("__k"))
    ends = ends.join(template, ["__src", "__nth"]).agg(F.min(F.expr(f"__b div __k * {period}") + F.col("__t")).alias("__horizon"))
    bucket = F.expr(f"mix_slot div {max(1, BUCKET_DOCS // block_docs)}")
    d = with_position(d, bucket, ["mix_slot", "__rank"], "mix_position").crossJoin(F.broadcast(ends))  # one row
    return d.select("__row.*", "mix_slot", (F.col("mix_position") - 1).alias("mix_position"), (F.col("mix_slot") < F.col("__horizon")).alias("mix_on_target"))


def mix(
    docs: DataFrame,
    shares: dict[str, int],
    default_share: int = 1,
    block_docs: int = 16,
    id_col: str = "doc_id",
    source_col: str = "source",
    columns: list[str] | None = None,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """``docs`` with ``mix_slot``, ``mix_position`` (gapless from 0) and ``mix_on_target``.

    ``mix_on_target`` holds up to the first slot that finds its source exhausted.
    Rows are not sorted by position; ``orderBy("mix_position")`` does that.
    """
    names = _sources(docs, source_col)
    if not names:
        return docs.select(columns or docs.columns).withColumns(
            {"mix_slot": F.lit(0).cast("long"), "mix_position": F.lit(0).cast("long"), "mix_on_target": F.lit(True)}
        )
    k = [shares.get(name, default_share) if name is not None else default_share for name in names]
    period = sum(k)
    if min(k) < 1 or period > MAX_PERIOD:
        raise ValueError(f"shares must be positive and sum to at most {MAX_PERIOD}")
    slots = edf_template(k)
    if period * len(k) > max_cells:
        return _by_tables(docs, names, k, slots, block_docs, id_col, source_col, columns)
    before, prefix = [[0] * len(k)], [0] * len(k)
    for s in slots:
        prefix[s] += 1
        before.append(list(prefix))

    def longs(values: list[int]) -> Column:
        return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")

    index = F.lit(len(k) - 1)  # a null source is last in ``names``
    lookup = [x for x in names if x is not None]
    if lookup:
        at = F.array_position(F.array(*[F.lit(x) for x in lookup]), F.col(source_col))
        index = F.when(F.col(source_col).isNull(), index).otherwise((at - 1).cast("int"))
    d = docs.select(*_carried(docs, columns, id_col), index.alias("__src"))
    sizes = {r[0]: r[1] for r in d.groupBy("__src").count().collect()}  # a row a source
    n = [sizes.get(i, 0) for i in range(len(k))]
    d = _ranked(d, max(sizes.values(), default=0))
    block = F.expr(f"__rank div {block_docs}")
    share = F.get(longs(k), F.col("__src"))
    d = d.withColumns({"__block": block, "__k": share})
    own = [[t for t, s in enumerate(slots) if s == i] for i in range(len(k))]
    of_source = "array(" + ",".join("array(" + ",".join(f"{t}L" for t in x) + ")" for x in own) + ")"
    inner = F.get(F.get(F.expr(of_source), F.col("__src")), (F.col("__block") % F.col("__k")).cast("int"))
    slot = F.expr("__block div __k") * period + inner
    d = d.withColumn("mix_slot", slot)
    # documents of all sources that stand in earlier slots
    at_slot = "array(" + ",".join("array(" + ",".join(f"{v}L" for v in row) + ")" for row in before[:-1]) + ")"
    prefix_col = F.get(F.expr(at_slot), (F.col("mix_slot") % period).cast("int"))
    whole = F.expr(f"mix_slot div {period}")
    d = d.withColumns({"__whole": whole, "__prefix": prefix_col})
    filled = F.zip_with(
        F.zip_with(longs(k), F.col("__prefix"), lambda a, b: (F.col("__whole") * a + b) * block_docs), longs(n), lambda a, b: F.least(a, b)
    )
    position = F.aggregate(filled, F.lit(0).cast("long"), lambda a, x: a + x) + F.col("__rank") % block_docs
    blocks = [-(-x // block_docs) for x in n]
    horizon = min((b // s) * period + own[i][b % s] for i, (b, s) in enumerate(zip(blocks, k)))
    return d.select("__row.*", "mix_slot", position.alias("mix_position"), (F.col("mix_slot") < horizon).alias("mix_on_target"))


def in_order(docs: DataFrame, shares: dict[str, int], block_docs: int = 16, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` sorted by their position in the mix, so that written files follow it."""
    return mix(docs, shares, block_docs=block_docs, id_col=id_col, source_col=source_col).orderBy("mix_position").select(docs.columns)
