"""SimHash near-duplicates by multi-index hashing.

A fingerprint is two segments of 32 bits, and every segment has a table from its
values to fingerprints. Of two fingerprints at two or fewer bits some segment
differs in one bit at most, so each fingerprint asks the tables for the Hamming
balls of radius one around its segments: for its own value, and for those with one
more bit set (of two values at one bit, one asks for the other that way). What the
tables hold there is verified by the complete distance.

An entry of more than ``HOT`` fingerprints (a group of near copies) is not compared
member by member. All that it holds and all that ask for it are entered under the
ball of radius one around the whole fingerprint instead: 65 keys each, where any two
at two or fewer bits meet and no more than 65 fingerprints can, and a key links its
fingerprints to the smallest one.

Equal fingerprints are one node before that, so copies add no links.

Defined results: a null text, or one without words, has fingerprint zero and
links like any other; fewer words than a shingle make one shingle; a text of any
length is read whole, its shingles counted block by block; repeated rows share a
group; a null id takes its group's smallest id, or null if the group has none; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.llm.components import components
from keyfold.sources.shared import store

SEED = 42
MAX_DISTANCE = 2
#: Fingerprints of one table entry that are compared with all that ask for it.
HOT = 64
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 3) -> bytes:
    """The 8 bytes, big-endian, of the text's fingerprint."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return bytes(8)
    if len(words) <= shingle_words:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_digest, b" ".join
    shingles = zip(*[words[i:] for i in range(shingle_words)])
    hashes = np.frombuffer(b"".join([digest(join(x), SEED) for x in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[i : i + _BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp) with the fingerprint as a signed 64-bit integer."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = b"".join(fingerprint(x, shingle_words) for x in batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], ["id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col))
    return rows.mapInArrow(run, f"id {kind}, text_hash long, fp long").withColumnRenamed("id", id_col)


def _entry(segment: Column, number: int) -> Column:
    """The key of a value in the table of its segment."""
    return segment.bitwiseOR(F.lit(number << 32).cast("long"))


def _segments() -> list[Column]:
    return [F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fp", 32)]


def _bits(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))


def _near(u: str, v: str) -> Column:
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v))) <= MAX_DISTANCE


def _whole_balls(fps: DataFrame) -> DataFrame:
    """(u, v) links that connect the ``fp`` at two or fewer bits, by the ball of radius one around each."""
    ball = F.concat(F.array("fp"), F.transform(_bits(64), lambda bit: F.col("fp").bitwiseXOR(bit)))
    met = fps.select("fp", F.explode(ball).alias("key")).withColumn("least", F.min("fp").over(W.partitionBy("key")))
    return met.where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v")).where(_near("u", "v"))


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v) pairs of the distinct ``fp`` that connect all those at two or fewer bits."""
    held = distinct.select("fp", F.explode(F.array(*[_entry(s, i) for i, s in enumerate(_segments())])).alias("key"))
    asked = F.concat(
        *[F.array_append(F.filter(F.transform(_bits(32), lambda bit: _entry(s.bitwiseOR(bit), i)), lambda k: k != _entry(s, i)), _entry(s, i)) for i, s in enumerate(_segments())]
    )
    asked = distinct.select(F.col("fp").alias("by"), F.explode(asked).alias("key"))
    crowded = store(held.groupBy("key").count().where(F.col("count") > hot).select("key"), "hot-entries")
    met = asked.join(held.join(crowded, "key", "left_anti"), "key").where((F.col("by") != F.col("fp")) & _near("by", "fp"))
    met = met.select(F.greatest("by", "fp").alias("u"), F.least("by", "fp").alias("v"))
    crowd = held.join(crowded, "key", "left_semi").select("fp").unionByName(asked.join(crowded, "key", "left_semi").select(F.col("by").alias("fp")))
    return met.unionByName(_whole_balls(crowd.distinct())).distinct()


def _grouped(fps: DataFrame, id_col: str) -> DataFrame:
    """(fp, least_id, component) of the distinct fingerprints of a stored table."""
    distinct = store(fps.groupBy("fp").agg(F.min(id_col).alias("least_id")), "fingerprint-classes")
    labels = components(links(distinct.select("fp")))
    return distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) per row: 16 hex digits and the smallest id reachable by links."""
    fps = store(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    d = _grouped(fps, id_col)
    least = d.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_fp = d.join(least, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: of its smallest id, that with the smallest text hash.

    Rows of one id with different texts are rows of their own, in their own groups;
    rows with a null id cannot be named and all stay.
    """
    fps = store(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    named = fps.where(F.col(id_col).isNotNull())
    first = named.groupBy("fp").agg(F.min(F.struct(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"))).alias("first"))
    keep = _grouped(fps, id_col).join(first, "fp").groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"))
    kept = d.join(keep, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
    return kept.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
