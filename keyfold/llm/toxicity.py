"""Toxicity from subword bags: character n-gram embeddings under a linear softmax.

A word is the mean of the embeddings of itself and its n-grams (with word
boundaries), a window the mean of its words; softmax over a linear layer gives its
class. A document scores as its most toxic window, so a few words count the same in
a long text as in a short one; windows begin at every word and overlap. Embeddings
and layer are trained jointly in numpy, first on whole-document means, then on the
worst windows. n-grams are shared by unseen misspellings. For scoring, a word comes
down to one number, which each worker keeps.

Training takes at most ``max_rows`` labelled documents of together at most
``max_bytes``, chosen by a hash of id and text; scoring reads every whole text.

Defined results: a null or empty text has one empty window and scores by the
bias alone; texts below the size of a window are one window, texts of any length
have all of theirs; repeated rows score alike, and count once in training; without
usable labels of both classes every score is the share of label 1 (0.5 without
labels); an empty table gives an empty result; columns beyond id and text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.labels import one_label

STRIP = "\"'.,;:!?()[]{}«»“”„…-–—"
BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
WINDOW = 5


def gram_buckets(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of ``<word>`` and its byte n-grams, all words after one another, and each word's first place."""
    data = [b"<" + w.strip(STRIP).encode("utf-8", "replace") + b">" for w in words]
    sizes = np.array([len(x) for x in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(data)), sizes)
    ends = np.cumsum(sizes)[owner]
    at = np.arange(len(flat))
    found, owners = [], []
    for n in GRAMS:
        h = np.full(max(0, len(flat) - n + 1), n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(n):
            h = (h ^ flat[k : len(flat) - n + 1 + k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(32)
        inside = at[: len(h)] + n <= ends[: len(h)]
        found.append((h % np.uint64(buckets)).astype(np.int64)[inside])
        owners.append(owner[: len(h)][inside])
    # the word itself: a polynomial over its bytes
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=1)), 0x100000001B3, np.uint64))
        whole = np.add.reduceat((flat + np.uint64(1)) * powers[at - starts[owner]], starts)
    whole ^= whole >> np.uint64(29)
    found.append((whole % np.uint64(buckets)).astype(np.int64))
    owners.append(np.arange(len(data)))
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(own[order], np.arange(len(words)))


def _counts(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.append(first, len(grams)))


def _by_part(words: list[str], size: int = 20_000) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """(place, words, buckets, firsts) of runs of ``words``, so that memory stays small."""
    for i in range(0, len(words), size):
        own = words[i : i + size]
        yield i, own, *gram_buckets(own)


@dataclass
class Model:
    """Per-bucket contributions (embedding times layer) and the bias of class 1 over class 0."""

    contribution: np.ndarray
    bias: float
    constant: float | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        grams, first = gram_buckets(words, len(self.contribution))
        sums = np.add.reduceat(self.contribution[grams], first)
        return sums / _counts(grams, first)


class Windows:
    """The windows of documents of one word at least, laid end to end."""

    def __init__(self, lengths: np.ndarray):
        self.n, self.lengths = int(lengths.sum()), lengths
        self.first = np.cumsum(lengths) - lengths
        self.size = np.minimum(lengths, WINDOW)
        self.outside = np.repeat(self.first + lengths, lengths) - np.arange(self.n) < WINDOW  # they would reach into the next document
        self.short = np.flatnonzero(lengths < WINDOW)

    def worst(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean, total of each window's words by its first word), the mean that of each document's highest window."""
        total = np.full(self.n, -np.inf)
        if self.n >= WINDOW:
            # a sum of its own for every window, so that equal texts get equal scores
            inner = total[: self.n - WINDOW + 1]
            inner[:] = word[: len(inner)]
            for k in range(1, WINDOW):
                inner += word[k : k + len(inner)]
        total[self.outside] = -np.inf
        if len(self.short):
            total[self.first[self.short]] = np.add.reduceat(word, self.first)[self.short] * (WINDOW / self.lengths[self.short])
        return np.maximum.reduceat(total, self.first) / WINDOW, total

    def places(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, document) of the words of each document's first highest window."""
        best, total = self.worst(word)
        top = np.flatnonzero(total / WINDOW == np.repeat(best, self.lengths))
        at = top[np.searchsorted(top, self.first)]
        ends = np.cumsum(self.size)
        return np.repeat(at - ends + self.size, self.size) + np.arange(ends[-1]), np.repeat(np.arange(len(at)), self.size)


@dataclass
class Bags:
    """Words of the training texts and the n-grams of each word."""

    grams: np.ndarray  # n-grams that have an embedding, word after word
    word_of: np.ndarray  # the word of each
    size: np.ndarray  # all n-grams of each word, with or without an embedding

    def words(self, emb: np.ndarray, layer: np.ndarray) -> np.ndarray:
        """Class 1 over class 0 for each word."""
        c = emb @ (layer[:, 1] - layer[:, 0])
        return np.bincount(self.word_of, c[self.grams], len(self.size)) / self.size

    def loss(self, params: list[np.ndarray], picked: np.ndarray, owner: np.ndarray, target: np.ndarray, weight: np.ndarray, decay: float) -> tuple[float, list[np.ndarray]]:
        """Weighted cross-entropy of softmax over the mean of each document's ``picked`` words, and its gradients."""
        emb, layer, bias = params
        n = len(target)
        share = 1.0 / np.bincount(owner, minlength=n)
        logit = np.bincount(owner, self.words(emb, layer)[picked], n) * share + bias[1] - bias[0]
        logit = np.clip(logit, -30, 30)
        p = 1 / (1 + np.exp(-logit))
        value = (weight * (np.logaddexp(0, logit) - target * logit)).sum() / n + decay / (2 * n) * (emb**2).sum()
        g = (p - target) * weight / n
        word_g = np.bincount(picked, (g * share)[owner], len(self.size)) / self.size
        c_g = np.bincount(self.grams, word_g[self.word_of], len(emb))
        c_g2 = np.stack([-c_g, c_g], 1)
        return value, [c_g2 @ layer.T + decay / n * emb, emb.T @ c_g2, np.array([-g.sum(), g.sum()])]


def fit(
    texts: list[str],
    y: np.ndarray,
    dims: int = 8,
    warm_up: int = 30,
    rounds: int = 90,
    rate: float = 0.1,
    decay: float = 0.3,
    min_share: float = 0.002,
    smoothing: float = 0.02,
    positive_weight: float = 3.0,
    seed: int = 0,
) -> Model:
    """Train embeddings and layer jointly with Adam over all of ``texts``.

    n-grams in less than ``min_share`` of the documents, or in one, keep a zero vector; ``smoothing``
    keeps single wrong labels from being learnt by heart; ``positive_weight``
    makes up for label 1 being rare.
    """
    constant = Model(np.zeros(1), 0.0, float(y.mean()) if len(y) else 0.5)
    vocabulary: dict[str, int] = {}
    tokens = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in (t or "").lower().split()], np.int32) for t in texts]
    keep = [i for i, x in enumerate(tokens) if len(x)]
    if not keep or y[keep].min() == y[keep].max():
        return constant
    y, lengths = y[keep].astype(np.float64), np.array([len(tokens[i]) for i in keep], np.int64)
    word_docs = np.bincount(np.concatenate([np.unique(tokens[i]) for i in keep]), minlength=len(vocabulary))
    flat = np.concatenate([tokens[i] for i in keep])
    del tokens
    words = list(vocabulary)
    del vocabulary
    n_words = len(words)
    docs_of = np.zeros(BUCKETS)
    for i, own, grams, first in _by_part(words):
        docs_of += np.bincount(grams, np.repeat(word_docs[i : i + len(own)], _counts(grams, first)), BUCKETS)
    usual = np.flatnonzero(docs_of >= max(2, round(min_share * len(y))))
    number = np.full(BUCKETS, -1, np.int32)
    number[usual] = np.arange(len(usual))
    n_grams, parts, owners = np.zeros(n_words), [], []
    for i, own, grams, first in _by_part(words):
        counts = _counts(grams, first)
        n_grams[i : i + len(own)] = counts
        inside = number[grams] >= 0
        parts.append(number[grams[inside]])
        owners.append(np.repeat(np.arange(i, i + len(own), dtype=np.int32), counts)[inside])
    bags = Bags(np.concatenate(parts), np.concatenate(owners), n_grams)
    del words, parts, owners
    rng = np.random.default_rng(seed)
    share = y.mean()
    params = [rng.normal(0, 0.1, (len(usual), dims)), rng.normal(0, 0.1, (dims, 2)), np.array([0.0, np.log(share / (1 - share))])]
    emb, layer, bias = params
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    doc_of, target = np.repeat(np.arange(len(y), dtype=np.int32), lengths), y * (1 - 2 * smoothing) + smoothing
    weight, windows = np.where(y > 0, positive_weight, 1.0), Windows(lengths)
    for t in range(1, warm_up + rounds + 1):
        picked, owner = flat, doc_of
        if t > warm_up:
            at, owner = windows.places(bags.words(emb, layer)[flat])
            picked = flat[at]
        _, grads = bags.loss(params, picked, owner, target, weight, decay)
        for p, q, a, b in zip(params, grads, m, v):
            a += 0.1 * (q - a)
            b += 0.001 * (q * q - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-9)
    contribution = np.zeros(BUCKETS, np.float32)
    contribution[usual] = emb @ (layer[:, 1] - layer[:, 0])
    return Model(contribution, float(bias[1] - bias[0]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 6000,
    max_bytes: int = 64 << 20,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    usable=None,
) -> Model:
    """Fit on at most ``max_rows`` labelled documents of at most ``max_bytes``. ``usable`` filters the label ids (column ``id``).

    The driver first takes ids and sizes, then the texts of the longest run of them,
    in the order of their hashes, that keeps within the bytes.
    """
    y = one_label(labels, label_col, "doc_id")
    if usable is not None:
        y = y.where(usable)
    key = F.xxhash64(id_col, text_col).alias("h")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n")
    sizes = docs.select(F.col(id_col).alias("id"), key, size).join(y, "id")  # no texts meet the labels
    sizes = sizes.groupBy("id", "h").agg(F.max("n").alias("n"), F.max("y").alias("y"))
    chosen = sizes.orderBy("h", "id").limit(max_rows).collect()
    kept = int(np.searchsorted(np.cumsum([r["n"] for r in chosen]), max_bytes, "right"))
    if not kept:
        return fit([], np.zeros(0))
    named = docs.sparkSession.createDataFrame([(r["id"], r["h"], r["y"]) for r in chosen[:kept]], sizes.select("id", "h", "y").schema)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key).join(F.broadcast(named), ["id", "h"])
    rows = rows.dropDuplicates(["id", "h"]).select("h", "text", "y").collect()
    rows.sort(key=lambda r: (r["h"], r["text"] or ""))
    return fit([r["text"] or "" for r in rows], np.array([r["y"] for r in rows]))


class Scorer:
    """Scores texts, keeping the numbers of the words seen."""

    def __init__(self, model: Model, max_entries: int = 400_000):
        self.model, self.max_entries, self.known = model, max_entries, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        words = [(t or "").lower().split() for t in texts]
        if len(self.known) > self.max_entries:
            self.known.clear()
        known = self.known
        missing = list(set().union(*words).difference(known))
        if missing:
            known.update(zip(missing, self.model.word_scores(missing).tolist()))
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter((known[x] for w in words for x in w), np.float64, int(lengths.sum()))
        out = np.zeros(len(texts))
        full = np.flatnonzero(lengths)
        if len(full):
            out[full] = Windows(lengths[full]).worst(flat)[0]
        return 1 / (1 + np.exp(-np.clip(out + self.model.bias, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch: int = 256) -> DataFrame:
    """(id, score) of every whole text."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                yield pa.record_batch([part.column(0), pa.array(scorer.scores(part.column(1).to_pylist()))], ["id", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
