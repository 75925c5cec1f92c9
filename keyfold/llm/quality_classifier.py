"""Quality by regularised quadratic discriminant analysis of document statistics.

Each whole text becomes a few transformed statistics. Spark sums their first and
second moments by class over every usable labelled row; each class covariance is
shrunk towards the pooled one and towards its diagonal, and its Cholesky factor
is inverted once. The score is the posterior of class 1 from the difference of
the two Gaussian log densities (Mahalanobis distances plus log determinants).

Defined results: a null or empty text has zero statistics; a text of any length is
measured whole; repeated rows score alike, and a repeated labelled row counts as
often; where labels of an id differ, the larger one holds; a score of just the
threshold passes; without usable labels of both classes every score is the share of
label 1 (0.5 without labels); an empty table gives an empty result; columns beyond id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.labels import one_label

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"
STATISTICS = ["words", "distinct_share", "word_bytes", "upper", "symbols", "marks", "repeats", "dup_lines", "line_words"]


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of :data:`STATISTICS`."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    size = sum(map(len, words))

    def count(chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    return [
        np.log1p(n),
        np.log1p(len(set(words))) / np.log1p(n),
        np.log(size / n),
        np.sqrt(count(UPPER) / size),
        np.sqrt(min(4.0, count(SYMBOLS) / n)),
        np.sqrt(min(4.0, count(MARKS) / n)),
        np.sqrt(sum(map(eq, words, words[1:])) / n),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        np.log1p(n / len(lines)),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics) of every row."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, x array<double>").withColumnsRenamed({"id": id_col, "x": "statistics"})


@dataclass
class Model:
    """Class means, inverted Cholesky factors and log terms (class 0, class 1)."""

    mean: np.ndarray
    whiten: np.ndarray
    log_term: np.ndarray
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        d = [self.log_term[k] - 0.5 * (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -700, 700)))


def fit(measured: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", usable=None, pooled: float = 0.2, diagonal: float = 0.1, ridge: float = 1e-2) -> Model:
    """Fit on all labelled rows of ``measured``; ``usable`` filters the label ids (column ``id``).

    ``pooled`` and ``diagonal`` are the shares of the pooled covariance and of the
    diagonal in each class covariance; ``ridge`` is added to every variance.
    """
    y = one_label(labels, label_col, "doc_id")
    if usable is not None:
        y = y.where(usable)
    d = len(STATISTICS)
    x = [F.col("statistics")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = measured.join(y, measured[id_col] == y.id).groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    )
    rows = {r["y"]: r for r in sums.collect()}  # one row a class
    if set(rows) != {0, 1}:
        return Model(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), float(next(iter(rows))) if rows else 0.5)
    n = np.array([rows[k]["n"] for k in (0, 1)], float)
    mean = np.array([[rows[k][f"s{i}"] / n[k] for i in range(d)] for k in (0, 1)])
    scatter = np.zeros((2, d, d))
    for k in (0, 1):
        for i, j in pairs:
            scatter[k, i, j] = scatter[k, j, i] = rows[k][f"p{i}_{j}"] - n[k] * mean[k, i] * mean[k, j]
    common = scatter.sum(0) / n.sum()
    whiten, log_term = [], []
    for k in (0, 1):
        own = (1 - pooled) * scatter[k] / n[k] + pooled * common
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + ridge * np.eye(d)
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor))
        log_term.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Model(mean, np.array(whiten), np.array(log_term))


def score(measured: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every measured row."""
    kind = measured.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.record_batch([b.column(0), pa.array(model.scores(x))], ["id", "score"])

    return measured.select(F.col(id_col), "statistics").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def filtered(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, in one pass without a join."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t) for t in b.column(at).to_pylist()])
                yield b.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
