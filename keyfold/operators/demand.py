"""Analytics of the traffic itself: hot keys, split points, baselines, routing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.functions.typed import basis_points, key_token

MIN_RECORDS = 10


def rollup(feed: DataFrame, window: Column, tracked: int = 512, key: str = "key") -> DataFrame:
    """(window, token, n, first_pos, tracked): counts per key token, the first ``tracked`` tokens seen marked.

    Ranks run over a row a token; the records themselves are combined first.
    """
    d = feed.groupBy(window.alias("window"), key_token(F.col(key)).alias("token")).agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.sum(F.octet_length("payload").cast("long")).alias("bytes")
    )
    # the place of the last tracked token decides for all others, so only the first ones are ranked
    nth = F.row_number().over(W.partitionBy("window").orderBy("first_pos"))
    last = d.select("window", "first_pos", nth.alias("__nth")).where(F.col("__nth") <= tracked).groupBy("window").agg(F.max("first_pos").alias("__last"))
    return d.join(last, "window").withColumn("tracked", F.col("first_pos") <= F.col("__last")).drop("__last")


def _totals(counts: DataFrame) -> DataFrame:
    """(window, total): records of all tokens, tracked or not."""
    return counts.groupBy("window").agg(F.sum("n").alias("total"))


def weighted_median(counts: DataFrame) -> DataFrame:
    """(window, median): the smallest tracked token at which the running count reaches half of all records, or null."""
    running = F.sum("n").over(W.partitionBy("window").orderBy("token").rowsBetween(W.unboundedPreceding, 0))
    d = counts.where("tracked").withColumn("__running", running).join(_totals(counts), "window")
    found = d.where(F.col("__running") >= F.ceil(F.col("total") / 2)).groupBy("window").agg(F.min("token").alias("median"))
    return _totals(counts).select("window").join(found, "window", "left")


def top_keys(counts: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` heaviest tracked tokens of each window with their share in basis points."""
    nth = F.row_number().over(W.partitionBy("window").orderBy(F.desc("n"), "token"))
    d = counts.where("tracked").withColumn("rank", nth).where(F.col("rank") <= k).join(_totals(counts), "window")
    return d.select("window", "rank", "token", "n", basis_points(F.col("n"), F.col("total")).alias("share_bp"))


def next_tokens(counts: DataFrame) -> DataFrame:
    """(window, top, next): the heaviest tracked token and the smallest one above it."""
    tracked = counts.where("tracked")
    top = tracked.groupBy("window").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("token").alias("t")))["t"].alias("top"))
    d = tracked.join(top, "window")
    return d.groupBy("window", "top").agg(F.min(F.when(F.col("token") > F.col("top"), F.col("token"))).alias("next"))


def isolation_boundary(hot: Column, next_token: Column, start: Column, end: Column) -> Column:
    """Where to cut so that a hot token stands alone: at it if inside the range, else after it, else nowhere."""
    return F.when((hot > start) & (hot < end), hot).when((next_token > start) & (next_token < end), next_token)


def window_tops(counts: DataFrame, clear_bp: int = 3000) -> DataFrame:
    """(range, window, total, top, top_n, counts) for :func:`hot_keys` of ``counts`` (range, window, token, n).

    ``counts`` keeps the tokens with a share of at least ``clear_bp``, as all others clear alike: at most three at 3000.
    """
    d = counts.withColumn("__total", F.sum("n").over(W.partitionBy("range", "window")))
    heavy = F.when(F.col("n") * 10000 >= clear_bp * F.col("__total"), F.struct("token", "n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("token").alias("t")))
    d = d.groupBy("range", "window").agg(
        F.max("__total").alias("total"), best.alias("__best"), F.map_from_entries(F.collect_list(heavy)).alias("counts")
    )
    return d.select("range", "window", "total", F.col("__best")["t"].alias("top"), (-F.col("__best")["m"]).alias("top_n"), "counts")


def hot_keys(windows: DataFrame, share_bp: int = 5000, clear_bp: int = 3000, raise_after: int = 2, clear_after: int = 15) -> DataFrame:
    """(range, window, flagged): the token flagged after each window, or null.

    ``windows`` holds (range, window, total, top, top_n) and, in ``counts``, the
    counts of that window by token, at least those from ``clear_bp`` on. Thin windows change nothing. Each range is
    one ordered fold over its windows.
    """
    order = ["range", "window", "total", "top", "top_n", "counts"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flagged, streak, candidate, calm, out = None, 0, None, 0, []
        for r in pdf.sort_values("window").itertuples(index=False):
            if r.total >= MIN_RECORDS:
                big = r.top_n * 10000 // r.total >= share_bp
                streak = streak + 1 if big and r.top == candidate else int(big)
                candidate = r.top if big else None
                if flagged is not None:
                    own = dict(r.counts).get(flagged, 0)
                    calm = calm + 1 if own * 10000 // r.total < clear_bp and r.top != flagged else 0
                    if calm >= clear_after:
                        flagged, calm = None, 0
                if flagged is None and streak >= raise_after:
                    flagged, calm = candidate, 0
            out.append((key[0], r.window, flagged))
        return pd.DataFrame(out, columns=["range", "window", "flagged"])

    kind = windows.schema["range"].dataType.simpleString()
    return windows.select(*order).groupBy("range").applyInPandas(run, f"range {kind}, window long, flagged string")


def baseline(samples: DataFrame, min_rates: int = 60, streak: int = 3) -> DataFrame:
    """Each subject's rate per minute against its history: learning, normal, or out of line.

    ``samples`` holds (subject, at_ns, total) of running totals. The last rate is
    out if above 1.5 times the largest or the median earlier rate, or below the
    median divided by 1.5; the state flips once the last ``streak`` rates agree.
    """
    w = W.partitionBy("subject").orderBy("at_ns")
    minutes = (F.col("at_ns") - F.lag("at_ns").over(w)) / F.lit(60e9)
    rates = samples.withColumn("rate", (F.col("total") - F.lag("total").over(w)) / minutes).where("rate is not null")
    size = F.count(F.lit(1)).over(W.partitionBy("subject"))
    rates = rates.withColumns({"n": size, "nth": F.row_number().over(w)})
    old = rates.where(F.col("nth") <= F.col("n") - streak)
    ordered = old.groupBy("subject").agg(F.sort_array(F.collect_list("rate")).alias("rs"), F.max("rate").alias("top"))
    history = ordered.select("subject", "top", F.get("rs", F.expr("cast(size(rs) div 2 as int)")).alias("median"))
    recent = rates.where(F.col("nth") > F.col("n") - streak).join(history, "subject", "left")
    out = (F.col("rate") > 1.5 * F.col("top")) | (F.col("rate") > 1.5 * F.col("median")) | (F.col("rate") < F.col("median") / 1.5)
    return recent.groupBy("subject").agg(
        F.max("n").alias("rates"),
        F.max("median").alias("median"),
        F.when(F.max("n") < min_rates, "learning").when(F.bool_and(F.coalesce(out, F.lit(False))), "out").otherwise("normal").alias("state"),
    )


def route(feed: DataFrame, ranges: DataFrame, key: str = "key") -> DataFrame:
    """``feed`` with the id of the range that holds its key's token.

    ``ranges`` (range_id, start, end) are contiguous, any number of them, the last
    one with an end that no token reaches. A range stands under each two-digit
    prefix that it touches, so a token is compared with the ranges of its prefix alone.
    """
    first = F.conv(F.substring(F.rpad("start", 2, "0"), 1, 2), 16, 10).cast("int")
    beyond = F.length("end") > 32  # one past the largest token has a digit more
    last = F.when(beyond, 255).otherwise(F.conv(F.substring(F.rpad("end", 2, "0"), 1, 2), 16, 10).cast("int"))
    by_prefix = ranges.select("range_id", "start", "end", beyond.alias("__beyond"), F.explode(F.sequence(first, F.greatest(first, last))).alias("__prefix"))
    d = feed.withColumn("__token", key_token(F.col(key)))
    d = d.withColumn("__prefix", F.conv(F.substring("__token", 1, 2), 16, 10).cast("int"))
    inside = (F.col("start") <= F.col("__token")) & (F.col("__beyond") | (F.col("__token") < F.col("end")))
    joined = d.alias("d").join(by_prefix.alias("r"), (F.col("d.__prefix") == F.col("r.__prefix")) & inside, "left")
    return joined.select(*[F.col(f"d.`{c}`") for c in feed.columns], "range_id")


def range_gaps(ranges: DataFrame) -> DataFrame:
    """Ranges whose end is not the next one's start; a sound map has none but its last."""
    following = F.lead("start").over(W.orderBy("start"))
    return ranges.withColumn("next_start", following).where(F.col("next_start").isNotNull() & (F.col("end") != F.col("next_start")))


def batch_ewma(samples: DataFrame, by: str, order: str, value: str, weight: float = 0.8) -> DataFrame:
    """The exponentially weighted mean of each ``by``'s ordered values; null if one of them is.

    A weighted sum: a value counts ``(1 - weight) * weight ** rows after it``, the
    first one without the factor. Ranges of the order are summed apart, so no task
    holds a whole ``by``; only a row a range and ``by`` is accumulated.
    """
    d = samples.select(F.col(by).alias("__by"), F.col(order).alias("__o"), F.col(value).cast("double").alias("__v"))
    d = d.repartitionByRange("__by", "__o", "__v").withColumn("__range", F.spark_partition_id())
    after = F.row_number().over(W.partitionBy("__by", "__range").orderBy(F.desc("__o"), F.desc("__v"))) - 1
    least = F.lit(5e-324)  # a weight of zero would turn an infinite value into NaN
    weighted = F.col("__v") * F.greatest(F.pow(F.lit(weight), F.col("__after")), least)
    sums = d.withColumn("__after", after).groupBy("__by", "__range").agg(
        F.count(F.lit(1)).alias("__n"),
        F.count("__v").alias("__known"),
        F.sum(weighted).alias("__sum"),
        F.max_by(weighted, "__after").alias("__first"),
    )
    later = W.partitionBy("__by").orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__w", F.greatest(F.pow(F.lit(weight), F.coalesce(F.sum("__n").over(later), F.lit(0))), least))
    total = F.sum(F.col("__w") * F.col("__sum")) * (1 - weight) + F.min_by(F.col("__w") * F.col("__first"), "__range") * weight
    ewma = F.when(F.sum("__known") == F.sum("__n"), total)
    return sums.groupBy(F.col("__by").alias(by)).agg(ewma.alias("ewma"))


def telemetry(samples: DataFrame, ids: list[str], counters: list[str], order: str) -> DataFrame:
    """Sums and latest values of counters per id: partial aggregates only."""
    sums = [F.sum(c).alias(f"{c}_total") for c in counters]
    last = [F.max_by(c, order).alias(f"{c}_last") for c in counters]
    return samples.groupBy(*ids).agg(F.count(F.lit(1)).alias("samples"), *sums, *last)


def pressure_due(samples: DataFrame, by: str, order: str, pressed: Column, n: int, cooldown: int = 0) -> DataFrame:
    """(by, order): the samples at which a split or merge becomes due, after ``n`` pressed ones on end.

    A sample that is not pressed starts the count again, and so does being due, after
    which ``cooldown`` samples count for nothing. A sorted stream of samples goes by;
    all that is kept is the count.
    """
    fields = samples.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, rest = None, 0, 0
        for batch in batches:
            due = []
            subjects, hot = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, subject in enumerate(subjects):
                if subject != now:
                    now, count, rest = subject, 0, 0
                if rest:
                    rest -= 1
                    continue
                count = count + 1 if hot[i] else 0
                if count == n:
                    due.append(i)
                    count, rest = 0, cooldown
            yield batch.take(pa.array(due, pa.int64())).select([0, 1])

    d = samples.select(by, order, F.coalesce(pressed, F.lit(False)).alias("__p")).where(F.col(by).isNotNull())
    d = d.repartition(by).sortWithinPartitions(by, order)
    return d.mapInArrow(run, f"`{by}` {fields[by].dataType.simpleString()}, `{order}` {fields[order].dataType.simpleString()}")


def cold_pairs(ranges: DataFrame, rates: DataFrame, max_rate: int) -> DataFrame:
    """(left, right) neighbours in the range map that both see at most ``max_rate``; ranges without a rate see nothing."""
    d = ranges.join(rates, "range_id", "left").withColumn("rate", F.coalesce("rate", F.lit(0)))
    w = W.orderBy("start")  # a row a range
    d = d.withColumns({"right": F.lead("range_id").over(w), "__r": F.lead("rate").over(w)})
    return d.where((F.col("rate") <= max_rate) & (F.col("__r") <= max_rate)).select(F.col("range_id").alias("left"), "right")
