"""Labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def one_label(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y): one 0/1 label an id, the larger where rows differ; null ids and labels are left out."""
    d = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    return d.groupBy("id").agg(F.max("y").alias("y"))
