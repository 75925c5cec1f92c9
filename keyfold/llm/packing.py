"""Best-fit packing of token pieces into sequences, improved by swaps.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver. Bins with equal contents are one entry with a count, so best-fit
decreasing and the local search work on kinds of bins: their number depends on
the capacity, not on the documents. The search takes underfull bins and moves a
piece, exchanges one for one or two for one, as long as that raises the sum of
squared fills, so that full bins get fuller and the emptiest ones vanish. Pieces
of a length are interchangeable: each gets an ordinal among its length, and the
plan maps ranges of ordinals to sequences and offsets.

With an ``order`` the sequences follow it: the pieces are numbered along it and cut
into segments of ``SEGMENT``, each segment is packed by itself, its sequences come
after those of the segments before, and inside it by their first piece. A prefix of
the sequences thus holds a prefix of the pieces, up to one segment.

Defined results: a null or empty text is a document of just the end id; one of any
length is cut into pieces, the first of which may be shorter; null ids are packed like
any other; repeated rows are each packed; pieces of one length are interchangeable, and
those of equal id, place and checksum take their places in any order; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.functions.ordering import with_position
from keyfold.llm.tokenization import encoder
from keyfold.sources.shared import store

#: Pieces of one length that are numbered together, about.
SALTED = 1024
#: Pieces that are packed together where the order of the input counts.
SEGMENT = 2048
#: Rows of one file that are numbered together.
_ROWS = 8192

Bin = tuple[int, ...]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Counter[Bin]:
    """Kinds of bins with their counts, longest pieces first, each into the tightest gap."""
    bins: dict[int, Counter[Bin]] = defaultdict(Counter)  # by free space
    free: list[int] = []

    def put(kind: Bin, count: int) -> None:
        gap = capacity - sum(kind)
        if not bins[gap]:
            insort(free, gap)
        bins[gap][kind] += count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(free, length)
            gap = free[at] if at < len(free) else capacity
            fits = gap // length
            if at == len(free):
                kind, there = (), left
            else:
                kind, there = next(iter(bins[gap].items()))
            count = min(there, left // fits)
            if count == 0:  # the last bin of this length takes what is left
                count, fits = 1, left
            if at < len(free):
                bins[gap][kind] -= count
                if not bins[gap][kind]:
                    del bins[gap][kind]
                if not bins[gap]:
                    free.remove(gap)
            put(kind + (length,) * fits, count)
            left -= count * fits
    return Counter({kind: n for own in bins.values() for kind, n in own.items()})


def lower_bound(bins: Counter[Bin], capacity: int) -> int:
    """No packing of the same pieces has fewer bins."""
    return -(-sum(sum(k) * n for k, n in bins.items()) // capacity)


def local_search(bins: Counter[Bin], capacity: int) -> Counter[Bin]:
    """Moves and exchanges between underfull bins until the lower bound or no step raises the squared fill.

    A step treats all bins of two kinds at once. It ends, as every step raises a
    sum that the capacity bounds.
    """
    bins = Counter({tuple(sorted(k, reverse=True)): n for k, n in bins.items()})
    least = lower_bound(bins, capacity)
    while sum(bins.values()) > least:
        open_bins = sorted((k for k in bins if sum(k) < capacity), key=sum)
        offers: dict[int, list[tuple[Bin, Bin]]] = defaultdict(list)  # (bin, pieces) by size, the emptiest bin first
        for k in open_bins:
            for out in _choices(k):
                offers[sum(out)].append((k, out))
        sizes, gone, moved = sorted(offers), set(), False
        for a in reversed(open_bins):  # the fullest gains first
            step = None if a in gone else _improve(a, capacity, offers, sizes, bins, gone)
            if step:
                b, out_a, out_b = step
                n = bins[a] // 2 if a == b else min(bins[a], bins[b])
                for kind, out, into in ((a, out_a, out_b), (b, out_b, out_a)):
                    bins[kind] -= n
                    if not bins[kind]:
                        del bins[kind]
                    gone.add(kind)  # its offers are no longer what they were
                    if new := tuple(sorted(_without(kind, out) + into, reverse=True)):
                        bins[new] += n
                moved = True
        if not moved:
            break
    return bins


def _choices(kind: Bin) -> list[Bin]:
    """One or two pieces of a bin, each choice of lengths once."""
    return list(dict.fromkeys([(x,) for x in kind] + [(x, y) for i, x in enumerate(kind) for y in kind[i + 1 :]]))


def _without(kind: Bin, out: Bin) -> Bin:
    rest = list(kind)
    for x in out:
        rest.remove(x)
    return tuple(rest)


def _improve(a: Bin, capacity: int, offers: dict[int, list[tuple[Bin, Bin]]], sizes: list[int], bins: Counter[Bin], gone: set[Bin]):
    """(b, pieces a gives, pieces b gives): the step that fills ``a`` most, at the cost of a bin that raises the squared fill.

    Moves give nothing back; exchanges are one for one, two for one or one for two.
    """
    gap, fill = capacity - sum(a), sum(a)
    best, best_gain = None, 0
    for out in [(), *_choices(a)]:
        size = sum(out)
        at = bisect_left(sizes, size + gap + 1) - 1
        while at >= 0 and sizes[at] - size > best_gain:
            gain = sizes[at] - size
            for b, own in offers[sizes[at]]:
                if fill + gain <= sum(b):
                    break  # fuller bins follow
                if b not in gone and (b != a or bins[a] > 1) and len(out) + len(own) < 4:
                    best, best_gain = (b, out, own), gain
                    break
            at -= 1
        if best_gain == gap:
            break
    return best


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """(length, first, sequence, offset): pieces of ``length`` from ordinal ``first`` on go to sequences from ``sequence`` on."""
    bins = local_search(best_fit_decreasing(histogram, capacity), capacity)
    rows, used, sequence = [], Counter(), 0
    for kind, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in kind:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    if used != Counter(histogram):
        raise AssertionError("the plan does not hold every piece once")
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).astype("int64").sort_values(["length", "first"])


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    capacity: int = 1024,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: list[str] | None = None,
    special_as_text: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document's pieces, and the columns of ``order``."""
    order = order or []
    carried = docs.select(*order).schema if order else []
    schema = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, special_as_text)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows, at = [], []
            for i, own in enumerate(enc.encode_batch(batch.column(1))):
                ids = np.append(own, end).tobytes()
                for p, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    at.append(i)
                    rows.append((p, start, length, zlib.crc32(own)) + ((own,) if keep_ids else ()))
            columns = list(zip(*rows)) if rows else [()] * (4 + keep_ids)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    *(pa.array(c, t) for c, t in zip(columns, kinds)),
                    *(c.take(pa.array(at, pa.int64())) for c in batch.columns[2:]),
                ],
                [*["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids], *order],
            )

    out = f"id {schema}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    out += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carried)
    return docs.select(F.col(id_col), F.col(text_col), *order).mapInArrow(encode, out).withColumnRenamed("id", id_col)


def _by_length(p: pd.DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    return {k: tuple(g[c].to_numpy() for c in ("first", "sequence", "offset")) for k, g in p.groupby("length")}


def _places(at_length: dict[int, tuple[np.ndarray, ...]], length: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by their ordinal among those of their length."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        first, seq, off = at_length[n]
        i = np.searchsorted(first, ordinal[rows], "right") - 1
        sequence[rows] = seq[i] + ordinal[rows] - first[i]
        offset[rows] = off[i]
    return sequence, offset


def assign(found: DataFrame, capacity: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """``found`` (a stored table with ``length``) with ``sequence_id`` and ``offset``."""
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    at_length = _by_length(plan(histogram, capacity))
    salts = [1 + histogram.get(n, 0) // SALTED for n in range(capacity + 1)]
    own = F.get(F.expr("array(" + ",".join(map(str, salts)) + ")"), F.col("length").cast("int"))
    salted = found.withColumn("__salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), own))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    run = W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.select("length", "__salt", (F.sum("__n").over(run) - F.col("__n")).alias("__before"))  # a row for SALTED pieces
    order = W.partitionBy("length", "__salt").orderBy(id_col, "piece", "ids_crc32")
    d = salted.withColumn("__in", F.row_number().over(order)).join(counts, ["length", "__salt"])
    d = d.select(*found.columns, (F.col("__before") + F.col("__in") - 1).alias("__ordinal"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ordinal = pdf.pop("__ordinal").to_numpy()
            sequence, offset = _places(at_length, pdf["length"].to_numpy(), ordinal)
            yield pdf.assign(sequence_id=sequence, offset=offset)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return d.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def assign_in_order(found: DataFrame, order: list[str], capacity: int = 1024) -> DataFrame:
    """``found`` (a stored table of :func:`pieces`) with ``sequence_id`` and ``offset``; sequences follow (``order``, piece)."""
    *outer, row = order
    bucket = F.struct(*outer, F.expr(f"`{row}` div {_ROWS}").alias("__rows"))
    d = with_position(found, bucket, [*order, "piece"], "__pos")
    d = d.withColumn("__segment", F.expr(f"(__pos - 1) div {SEGMENT}")).drop(*order)

    def place(table: pa.Table) -> pa.Table:
        position, length = table["__pos"].to_numpy(), table["length"].to_numpy()
        ordinal = np.zeros(len(length), np.int64)
        by_length = np.lexsort((position, length))
        starts = np.flatnonzero(np.diff(length[by_length], prepend=-1))
        ordinal[by_length] = np.arange(len(length)) - np.repeat(starts, np.diff(starts, append=len(length)))
        sequence, offset = _places(_by_length(plan(Counter(length.tolist()), capacity)), length, ordinal)
        first = np.full(sequence.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, sequence, position)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        return table.drop_columns(["__pos"]).append_column("sequence_id", pa.array(rank[sequence])).append_column("offset", pa.array(offset))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("__pos").schema)
    placed = store(d.groupBy("__segment").applyInArrow(place, f"{fields}, sequence_id long, offset long"), "placed")
    sizes = placed.groupBy("__segment").agg((F.max("sequence_id") + 1).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__segment").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("__segment", F.coalesce(before, F.lit(0)).alias("__before"))  # a row a segment
    d = placed.join(sizes, "__segment").withColumn("sequence_id", F.col("sequence_id") + F.col("__before"))
    return d.drop("__segment", "__before")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = 1024,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: list[str] | None = None,
    special_as_text: bool = False,
) -> DataFrame:
    """Every piece with its sequence and place; ``keep_ids`` adds the ids themselves.

    ``order`` names columns that sequences follow, the last one a number.
    """
    found = store(pieces(docs, tokenizer_path, end_id, capacity, keep_ids, id_col, text_col, order, special_as_text), "pieces")
    if order:
        return assign_in_order(found, order, capacity)
    return assign(found, capacity, id_col)
