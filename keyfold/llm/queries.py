"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import (
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    token_binary,
    toxicity,
    url_filters,
    vector_dedup,
    warc,
)
from keyfold.llm.labels import held_out
from keyfold.sources.shared import new_path, store, table

EXPLICIT = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SHARES = {"src0": 4, "src1": 3, "src2": 3, "src3": 2, "src4": 2}
BLOCK_DOCS = 16
QUALITY_THRESHOLD = 0.3


TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    path = new_path(spark, "warc")
    warc.write_archive(pages, path, "page_id", "url", "payload", min_bytes=0, chunk_bytes=1024, segment_bytes=4096)
    read = warc.read_archive(spark, path).select(
        "record_id",
        "row_id",
        "warc_type",
        "refers_to",
        "complete",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("digest_ok"), F.substring_index("payload_digest", ":", -1)).alias("digest"),
    )
    d = warc.resolve(store(read, "warc-records"))
    return d.select(
        F.col("row_id").cast("long").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.col("refers_row").cast("long").alias("refers_to"),
        "complete",
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are the verdicts of the explicit rules; what is mined from them decides the URLs that no rule lists."""
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages, EXPLICIT, url_filters.mine_rules(url_filters.listed(pages, EXPLICIT)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, usable=~held_out(F.col("id"), 3, 1))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = store(quality_classifier.measure(table(spark, sf_dir, "documents")), "quality-statistics")
    model = quality_classifier.fit(measured, table(spark, sf_dir, "labels"), usable=~held_out(F.col("id"), 5, 0))
    return quality_classifier.score(measured, model).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted")
    )


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, capacity=1024)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, SHARES, block_docs=BLOCK_DOCS, columns=["doc_id", "source"])


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_binary.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=0)
    read = store(token_binary.read_tokens(spark, path), "token-documents")
    return token_binary.with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")


def _quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule evaluated once; policies read what is stored here."""
    return store(quality_rules.ledger(table(spark, sf_dir, "documents")), "quality-ledger")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base policy and the standard one over the stored ledger."""
    return _quality_ledger(spark, sf_dir).select(
        "doc_id",
        *quality_rules.MEASURES,
        "failure_bits",
        quality_rules.rejected(quality_rules.BASE).alias("base_failed"),
        (~quality_rules.rejected(quality_rules.STANDARD)).alias("kept"),
        F.lit(quality_rules.STANDARD.version).alias("policy"),
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of two policy versions rejects, and rejects alone."""
    entries = _quality_ledger(spark, sf_dir)
    return quality_rules.ablation(entries, quality_rules.BASE).unionByName(quality_rules.ablation(entries, quality_rules.STANDARD))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_url_filters": op2_url_filters,
    "op3_toxicity": op3_toxicity,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_token_binary": op9_token_binary,
    "op10_quality_rules": op10_quality_rules,
    "quality_ablation": quality_ablation,
}
