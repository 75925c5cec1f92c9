"""From raw documents to packed sequences: rules, quality, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import mixing, near_copies, packing, quality_classifier, quality_rules
from keyfold.llm.labels import held_out
from keyfold.llm.queries import BLOCK_DOCS, QUALITY_THRESHOLD, SHARES, tokenizer_path
from keyfold.sources.shared import store, table, with_row_order


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy rejects go.

    A null or empty text has too few words and goes; a text of any length is measured
    whole; equal rows and rows with a null id are judged each by itself, so there are
    no ties; an empty table stays empty; columns keep their names and values.
    """
    return quality_rules.filtered(docs, quality_rules.STANDARD)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled documents still there; those below the threshold go.

    A null text counts as empty and is scored like any other; a text of any length is
    measured whole; equal texts score alike, and a score of just the threshold stays;
    a row with a null id is scored but never fitted on; without labels of both classes
    nothing goes; an empty table stays empty; columns keep their names and values.
    """
    usable = ~held_out(F.col("id"), 5, 0)
    # only statistics meet the labels, so the texts are not shuffled
    model = quality_classifier.fit(quality_classifier.measure(docs), table(spark, sf_dir, "labels"), usable=usable)
    return quality_classifier.filtered(docs, model, QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, a similarity of 0.8 or more.

    Null and empty texts are copies of each other; texts of any length are compared
    whole; of a group the smallest id stays, of rows with that id the smallest text
    hash, of rows equal in both one; rows with a null id all stay; an empty table stays
    empty; columns keep their names and values.
    """
    return near_copies.one_of_each(docs, least=0.8, shingle_words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of the target weights; every document stays.

    Texts are not looked at, whatever they are; a null source is a source of its own;
    documents of a source are ordered by the hash of their id, ties by the id, null ids
    last, equal rows in any order; an empty table stays empty; columns keep their names
    and values.
    """
    return mixing.in_order(docs, SHARES, block_docs=BLOCK_DOCS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences, which follow the order of the rows.

    A null or empty text is a document of its end id; one of any length is cut into
    pieces; equal rows and rows with a null id are packed each by itself; pieces of one
    length are interchangeable and take the places for it in the order of the rows; an
    empty table gives no pieces; other columns are not read.
    """
    return packing.pack(with_row_order(docs), tokenizer_path(), end_id=2, capacity=1024, order=["__file", "__row"])


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: Fingerprints, the fitted discriminant and the tokenizer have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
