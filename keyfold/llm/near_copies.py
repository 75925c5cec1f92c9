"""Near copies by multi-index hashing of SimHash fingerprints, verified by the texts themselves.

Two texts link if their sets of five-word shingles have a Jaccard similarity of at
least 0.8. Candidates come from a fingerprint of 128 bits over a text's different words:
a changed word changes one of these features, but five shingles, so near copies lie at
few bits. The fingerprint is cut into six segments with a table each; two at
``MAX_DISTANCE`` bits or fewer differ in one bit at most in some segment, so each text
asks the tables for the balls of radius one around its segments. What is met there is
verified twice: by the complete distance, then by the shingles of both texts. Links
that lie at more bits are not met; the README has the share.

An entry of more than ``HOT`` texts would give all pairs of a large group. All that it
holds and all that ask for it are first compared with ``CENTRES`` of them, the same ones
for the entries of a group. What is joined that way needs no more pairs. What is left
meets by its rarest shingles: with the shingles of both in one order, rarest first, the
first that two similar texts share stands so early in each that the rest can still make
up what they must share. No similar pair is passed over, and texts that are near but not
similar, which differ in more than that, do not meet.

Texts that are looked for are first told from most others by a table of bits, so the
others are not shuffled.

Equal texts (up to case and white space) are one class before that.

Defined results: a null text, or one without words, is in one class with its like;
fewer than five words make one shingle; texts of any length are read whole; rows of
one id with different texts are rows of their own; of a group the row with the
smallest id stays, of its rows that with the smallest text hash; rows that repeat it
stay once; rows with a null id cannot be named and all stay; an empty table gives an
empty result; columns keep their names, whatever they are.
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

#: Half of the fingerprint, first bit and length of the segments.
SEGMENTS = [(half, first, length) for half in "ab" for first, length in ((0, 21), (21, 21), (42, 22))]
MAX_DISTANCE = 2 * len(SEGMENTS) - 1
HOT, CENTRES = 16, 2
#: Longs of a bit table, at most (it goes to every task); a full one lets more rows through, but loses none.
MAX_LONGS = 1 << 18
#: What rounding may take from a least number of shared shingles.
SLACK = 1e-6


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def bags(text: str | None) -> tuple[bytes, bytes]:
    """(class, fingerprint): eight bytes for the sequence of words, sixteen for the set of them."""
    words = _words(text)
    name = xxhash.xxh64_digest(b" ".join(words))
    different = set(words)
    if not different:
        return name, bytes(16)
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([digest(w) for w in different]), np.uint8).reshape(-1, 16)
    return name, np.packbits(2 * np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64) > len(hashes)).tobytes()


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The different shingles of a text, as sorted 32-bit hashes."""
    words, digest, join = _words(text), xxhash.xxh32_intdigest, b" ".join
    if len(words) <= size:
        return np.array([digest(join(words))], np.uint32)
    return np.unique(np.array([digest(join(x)) for x in zip(*[words[i:] for i in range(size)])], np.uint32))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, cid, a, b) of the rows with an id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bags(x) for x in batch.column(2).to_pylist()]
            names = np.frombuffer(b"".join([x for x, _ in found]), ">i8").astype(np.int64)
            prints = np.frombuffer(b"".join([x for _, x in found]), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.record_batch([*batch.columns[:2], *(pa.array(x) for x in (names, prints[:, 0], prints[:, 1]))], ["id", "text_hash", "cid", "a", "b"])

    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.xxhash64(text_col), F.col(text_col))
    return d.mapInArrow(run, f"id {kind}, text_hash long, cid long, a long, b long")


def _keys(classes: DataFrame, near: bool) -> DataFrame:
    """(cid, a, b, key) of the tables' entries, or of those that each class asks for: its own values and those with a bit more."""
    parts = []
    for i, (half, first, length) in enumerate(SEGMENTS):
        value = F.shiftrightunsigned(half, first).bitwiseAND(F.lit((1 << length) - 1).cast("long"))
        own = value.bitwiseOR(F.lit(i << 32).cast("long"))
        parts.append(F.array(own))
        if near:
            bits = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k))
            parts.append(F.array_remove(F.transform(bits, own.bitwiseOR), own))
    return classes.select("cid", "a", "b", F.explode(F.concat(*parts)).alias("key"))


def _pairs(x: DataFrame, y: DataFrame, unlike: Column | None = None) -> DataFrame:
    """Different (u, v) of two keyed tables that meet at a key within the distance."""
    x, y = x.alias("x"), y.alias("y")
    bits = [F.bit_count(F.col(f"x.{f}").bitwiseXOR(F.col(f"y.{f}"))) for f in ("a", "b")]
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") != F.col("y.cid")) & (bits[0] + bits[1] <= MAX_DISTANCE)
    d = x.join(y, met if unlike is None else met & unlike)
    return d.select(F.greatest("x.cid", "y.cid").alias("u"), F.least("x.cid", "y.cid").alias("v")).distinct()


def _bit_table(wanted: DataFrame, *columns: str) -> tuple[DataFrame, list[Column]]:
    """(at, bits), sixteen bits a row of the stored ``wanted`` where there is room, and the place and bit of a row by ``columns``."""
    longs = max(1, min(MAX_LONGS, wanted.count() // 4))
    name = F.xxhash64(*columns)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(name, 58).cast("int"))
    place = F.pmod(name, F.lit(longs).cast("long"))
    return F.broadcast(wanted.groupBy(place.alias("__at")).agg(F.bit_or(bit).alias("__bits"))), [place, bit]


def _perhaps(rows: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``__perhaps``: true for all that are among the stored ``wanted`` by ``columns``, and for few others."""
    bits, (place, bit) = _bit_table(wanted, *columns)
    met = rows.join(bits, place == F.col("__at"), "left")
    return met.withColumn("__perhaps", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__at", "__bits")


def _sets(wanted: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str, repeated: bool) -> DataFrame:
    """The stored (cid, s) of the ``wanted`` classes: their shingles. ``repeated`` rows are one."""
    wanted = store(wanted.select("cid", "first.id", "first.text_hash"), "candidate-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(x, size).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(own, pa.binary())], ["cid", "s"])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    texts = _perhaps(texts, wanted, "id", "text_hash").where("__perhaps").drop("__perhaps")
    sets = texts.join(wanted, ["id", "text_hash"]).select("cid", "text").mapInArrow(cut, "cid long, s binary")
    return store(sets.dropDuplicates(["cid"]) if repeated else sets, "shingles")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The (u, v) of the stored ``pairs`` whose shingles are similar."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()] for c in (2, 3)]
            good = [similarity(a, b) >= least for a, b in zip(*sides)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    # merged whatever their size: shingles grow with the documents
    sides = [sets.select(F.col("cid").alias(c), F.col("s").alias(f"s_{c}")).hint("merge") for c in "uv"]
    d = pairs.join(sides[0], "u").join(sides[1], "v")
    return store(d.select("u", "v", "s_u", "s_v").mapInArrow(judge, "u long, v long"), "verified-pairs")


def _rarest(sets: DataFrame, least: float) -> DataFrame:
    """(cid, key, at, n): the shingles, of n, by which a similar text can be met first, and their places from 1, rarest first."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.frombuffer(own, np.uint32).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(keys), x)) for x in (cid, len(keys))] + [pa.array(keys)], ["cid", "n", "key"])

    spelt = sets.mapInArrow(spell, "cid long, n long, key long")
    # those of one text only come first and meet nothing
    shared = spelt.join(spelt.groupBy("key").count().where("count > 1"), "key")
    text = W.partitionBy("cid")
    at = F.col("n") - F.count(F.lit(1)).over(text) + F.row_number().over(text.orderBy("count", "key"))
    return shared.withColumn("at", at).where(F.col("at") <= F.col("n") + 1 - F.ceil(F.col("n") * least - SLACK)).select("cid", "key", "at", "n")


def _rare_pairs(crowd: DataFrame, sets: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(u, v) of ``crowd`` (cid, a, b) within the distance, not of one label yet, with all similar ones among them."""
    crowd = crowd.join(labels, F.col("cid") == F.col("node"), "left").select("cid", "a", "b", F.coalesce("component", "cid").alias("label"))
    keyed = store(_rarest(sets, least).join(crowd, "cid"), "rare-shingles")
    sizes = keyed.groupBy("key", "label").count()
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = keyed.join(main, "key").where(F.col("label") != F.col("main")).drop("main")
    shared = F.ceil((F.col("x.n") + F.col("y.n")) * (least / (1 + least)) - SLACK)
    early = [F.col(f"{side}.at") + shared <= F.col(f"{side}.n") + 1 for side in "xy"]
    return _pairs(rest, keyed, (F.col("x.label") != F.col("y.label")) & early[0] & early[1])


def links(
    classes: DataFrame, docs: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, repeated: bool = True
) -> DataFrame:
    """(u, v) links that connect the stored ``classes`` (cid, a, b, first) as all their links would.

    ``repeated`` says whether rows of ``docs`` may be equal in id and text.
    """

    def shingled(cids: DataFrame) -> DataFrame:
        return _sets(classes.join(cids.distinct(), "cid"), docs, size, id_col, text_col, repeated)

    held, asked = _keys(classes, False), _keys(classes, True)
    crowded = store(held.groupBy("key").count().where(F.col("count") > hot).select("key"), "hot-entries")
    # merged whatever its size: what is held grows with the documents
    pairs = store(_pairs(asked, held.join(crowded, "key", "left_anti").hint("merge")), "candidate-pairs")
    ends = pairs.select(F.col("u").alias("cid")).unionByName(pairs.select(F.col("v").alias("cid")))
    found = _similar(pairs, shingled(ends), least)
    if crowded.isEmpty():
        return found
    crowd = store(held.join(crowded, "key", "left_semi").unionByName(asked.join(crowded, "key", "left_semi")).distinct(), "hot-members")
    nth = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("cid"), "cid"))
    centres = store(crowd.withColumn("nth", nth).where(F.col("nth") <= CENTRES).drop("nth"), "hot-centres")
    sets = shingled(crowd.select("cid"))
    found = found.unionByName(_similar(store(_pairs(crowd, centres), "candidate-pairs"), sets, least))
    rest = _rare_pairs(crowd.select("cid", "a", "b").distinct(), sets, components(found), least)
    return found.unionByName(_similar(store(rest, "candidate-pairs"), sets, least))


def one_of_each(docs: DataFrame, least: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    rows = store(_rows(docs, id_col, text_col), "word-bags")
    first = F.min(F.struct("id", "text_hash")).alias("first")
    classes = store(rows.groupBy("cid").agg(first, F.first("a").alias("a"), F.first("b").alias("b")), "text-classes")
    names = rows.groupBy("id", "text_hash").count()
    repeated = not names.where("count > 1").isEmpty()
    labels = components(links(classes, docs, least, shingle_words, id_col, text_col, hot, repeated))
    group = F.coalesce("component", "cid").alias("group")
    d = classes.join(labels, F.col("cid") == F.col("node"), "left").select("first", group)
    keep = store(d.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.id").alias("__id"), F.col("first.text_hash").alias("__hash")), "kept-rows")
    # rows that go or are repeated; all others stay where they are
    names = names.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "count").join(keep.withColumn("kept", F.lit(True)), ["__id", "__hash"], "left")
    other = store(names.where("kept is null or count > 1").select("__id", "__hash"), "other-rows")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.where(F.col(id_col).isNotNull()).select(row, F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"))
    d = _perhaps(d, other, "__id", "__hash")
    kept = d.where("__perhaps").join(keep, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
    return d.where("not __perhaps").select("row.*").unionByName(kept.select("row.*")).unionByName(docs.where(F.col(id_col).isNull()))
