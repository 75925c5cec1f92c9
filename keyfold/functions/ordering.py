"""Dense positions and running values over a long order, without one task for all rows.

The order is cut into buckets that follow it (an hour of delivery time, say).
Inside a bucket a window does the work; across buckets only a row a bucket is
accumulated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_position(df: DataFrame, bucket: Column, order: list[str], name: str = "pos") -> DataFrame:
    """``df`` with its dense position from 1 by ``order``; ``bucket`` must not decrease along it."""
    d = df.withColumn("__b", bucket)
    counts = d.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("__b", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__b").orderBy(*order))
    d = d.withColumn("__in", inside).join(counts, "__b")
    return d.withColumn(name, F.col("__before") + F.col("__in")).drop("__b", "__in", "__before")


def with_running_max(df: DataFrame, bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the largest ``value`` up to each row; ``bucket`` must not decrease along ``order``."""
    d = df.withColumn("__b", bucket)
    tops = d.groupBy("__b").agg(F.max(value).alias("__top"))
    tops = tops.select("__b", F.max("__top").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    inside = F.max(value).over(W.partitionBy("__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("__in", inside).join(tops, "__b")
    return d.withColumn(name, F.greatest("__before", "__in")).drop("__b", "__in", "__before")
