"""Near-duplicate vectors by product quantisation.

Unit vectors fall into the cells of a coarse quantiser; residuals are coded by
subspace codebooks. Let x lie in cell A and y in cell B, at a distance of r at most.
Then x.A - x.B and y.B - y.A are not negative and sum to (x - y).(A - B) <= r |A - B|,
so the lesser one is at most half of that: a vector probes the cells within half of
the bound, and of two linked vectors one finds the other, whatever the vectors are.
Within a cell, table lookups give asymmetric distances; as each code's error norm is
kept, a member is dropped only if even that error could not lift it to the threshold.
What is left is reranked by exact cosine in double precision. Links are counted and
connected block by block: a block returns one row a vector, never its pairs. Large
cells are cut into blocks of bounded size.

Equal vectors are one class with a count before that. Each length of vector has its
own index. The quantisers are fitted on at most ``sample`` classes (four a cell where
there are more cells than that), chosen by hash; every vector is indexed.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components have no links and are their own component; vectors of different lengths
do not link; rows with a null id take no part and get null; repeated rows count as
links of each other; a cosine of just the threshold links; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.components import components
from keyfold.sources.shared import store

#: Cells grow with the root of the classes: as many as the root, over this.
ROOT_SHARE = 4
#: More centres than this are fitted group by group.
MANY = 1024
MEMBERS, QUERIES = 1024, 2048
CODES = 256


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        half = 0 if unit else 0.5 * (centres**2).sum(1)
        near = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` unit centres; many of them group by group, so that the time grows with their root."""
    if k <= MANY:
        return _kmeans(x, k, 10, rng, unit=True)
    top = _kmeans(x, math.isqrt(k), 10, rng, unit=True)
    of = np.concatenate([np.argmax(x[i : i + 4096] @ top.T, axis=1) for i in range(0, len(x), 4096)])
    groups = [x[of == g] for g in range(len(top))]
    return np.concatenate([_kmeans(own, -(-k * len(own) // len(x)), 10, rng, unit=True) for own in groups if len(own)])


def cells_for(rows: int, share: int = ROOT_SHARE) -> int:
    """The cells of an index of ``rows`` classes."""
    return max(1, math.isqrt(rows) // share)


@dataclass
class Index:
    """Coarse centres, subspace cuts and codebooks."""

    centres: np.ndarray
    cuts: list[int]
    books: list[np.ndarray]
    reach: np.ndarray  # how much smaller x.B than x.A may be for B to be probed

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """(cell, probed cells, codes, error norm) of unit vectors."""
        dots = x @ self.centres.T
        cell = dots.argmax(1)
        gap = dots[np.arange(len(x)), cell][:, None] - dots
        probes = [np.flatnonzero(row).astype(np.int32) for row in gap <= self.reach[cell]]
        residual = x - self.centres[cell]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for s, book in enumerate(self.books):
            part = residual[:, self.cuts[s] : self.cuts[s + 1]]
            codes[:, s] = (part @ book.T - 0.5 * (book**2).sum(1)).argmax(1)
            error += ((part - book[codes[:, s]]) ** 2).sum(1)
        return cell, probes, codes, np.sqrt(error)

    def approximate(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Dot products of coded members with exact queries, by table lookup: a row a member, in single precision."""
        out = np.empty((len(codes), len(queries)), np.float32)
        out[:] = queries @ self.centres[cell]
        for s, book in enumerate(self.books):
            table = (book @ queries[:, self.cuts[s] : self.cuts[s + 1]].T).astype(np.float32)  # a row a code
            for i in range(0, len(codes), 128):
                out[i : i + 128] += table.take(codes[i : i + 128, s], axis=0)
        return out


def fit(sample: np.ndarray, cells: int, threshold: float, subspaces: int = 8, seed: int = 0) -> Index:
    """Fit the quantisers on unit vectors."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    centres = _centres(sample, min(cells, len(sample)), rng)
    near = np.concatenate([np.argmax(sample[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
    residual = sample - centres[near]
    cuts = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int).tolist()
    books = [_kmeans(residual[:, a:b], min(CODES, len(sample)), 8, rng) for a, b in zip(cuts, cuts[1:])]
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    return Index(centres, cuts, books, 0.5 * np.sqrt(2 * (1 - threshold)) * apart + 1e-9)


def _connect(q: np.ndarray, m: np.ndarray, q_ids: np.ndarray, m_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each query and member reaches over the links (q[i], m[i])."""
    a, b = q_ids.copy(), m_ids.copy()
    while True:
        old = a.sum(), b.sum()
        np.minimum.at(b, m, a[q])
        np.minimum.at(a, q, b[m])
        if old == (a.sum(), b.sum()):
            return a, b


def _links(index: Index, cell: int, q: np.ndarray, m: np.ndarray, codes: np.ndarray, error: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (query, member) of one block: lookups first, then the exact cosine of what may pass."""
    least = (threshold - 1e-5 - error).astype(np.float32)
    b, a = np.nonzero(index.approximate(q, cell, codes) >= least[:, None])
    # one sum for each pair, whatever block it stands in
    good = [np.einsum("ij,ij->i", q[a[i : i + 65536]], m[b[i : i + 65536]]) >= threshold for i in range(0, len(a), 65536)]
    good = np.concatenate([*good, np.zeros(0, bool)])
    return a[good], b[good]


def _unit(column: pd.Series, dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(column), kind).reshape(-1, dim).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _found(classes: DataFrame, dim: int, kind: str, threshold: float, sample: int, root_share: int) -> DataFrame:
    """(cid, links, hub) of the blocks: links of a class there, and the smallest class that it reaches."""
    spark = classes.sparkSession
    rows = classes.count()
    cells = cells_for(rows, root_share)
    picked = classes.orderBy(F.xxhash64("cid"), "cid").limit(max(sample, 4 * cells)).select("x").toPandas()["x"]
    known = np.stack(picked.to_numpy()).astype(float)
    index = fit(known / np.linalg.norm(known, axis=1, keepdims=True), cells, threshold)
    cells = len(index.centres)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 2048):
                part = pdf.iloc[i : i + 2048]
                x = np.stack(part["x"].to_numpy()).astype("<f8")
                cell, probes, codes, error = shared.value.assign(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pd.DataFrame(
                    {"cid": part["cid"], "n": part["n"], "v": [r.tobytes() for r in x.astype(kind)], "cell": cell.astype(np.int32), "probes": probes, "codes": [c.tobytes() for c in codes], "error": error}
                )

    indexed = store(classes.select("cid", "n", "x").mapInPandas(assign, "cid long, n long, v binary, cell int, probes array<int>, codes binary, error double"), "vector-index")
    members = {r[0]: r[1] for r in indexed.groupBy("cell").count().collect()}  # a row a cell
    queries = {r[0]: r[1] for r in indexed.select(F.explode("probes").alias("p")).groupBy("p").count().collect()}
    blocks = spark.createDataFrame(
        [(c, max(1, -(-members.get(c, 0) // MEMBERS)), max(1, -(-queries.get(c, 0) // QUERIES))) for c in range(cells)], "p int, m_blocks int, q_blocks int"
    )
    mix = F.xxhash64("cid", F.lit(1))
    asks = indexed.select("cid", "n", "v", "cell", F.explode("probes").alias("p")).join(blocks, "p")
    asks = asks.select("cid", "n", "v", "cell", "p", F.pmod(mix, F.col("q_blocks")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("mb"))
    holds = indexed.withColumn("p", F.col("cell")).join(blocks, "p").select(
        *[F.col(c).alias(c) for c in ("cid", "n", "v", "probes", "codes", "error", "p")], F.pmod(mix, F.col("m_blocks")).cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb")
    )

    def match(key: tuple, ask: pd.DataFrame, hold: pd.DataFrame) -> pd.DataFrame:
        cell = int(key[0])
        if not len(ask) or not len(hold):
            return pd.DataFrame({"cid": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "hub": np.zeros(0, np.int64)})
        q, m = _unit(ask["v"], dim, kind), _unit(hold["v"], dim, kind)
        codes = np.frombuffer(b"".join(hold["codes"]), np.uint8).reshape(len(hold), -1)
        a, b = _links(shared.value, cell, q, m, codes, hold["error"].to_numpy(), threshold)
        q_ids, m_ids = ask["cid"].to_numpy(), hold["cid"].to_numpy()
        other = q_ids[a] != m_ids[b]
        a, b = a[other], b[other]
        # a member that does not probe the query's cell would not find it
        q_cell = ask["cell"].to_numpy()
        probed = np.zeros((len(hold), cells), bool)
        for i, p in enumerate(hold["probes"]):
            probed[i, p] = True
        blind = ~probed[b, q_cell[a]]
        q_links = np.bincount(a, hold["n"].to_numpy()[b], len(q)).astype(np.int64)
        m_links = np.bincount(b[blind], ask["n"].to_numpy()[a[blind]], len(m)).astype(np.int64)
        q_hub, m_hub = _connect(a, b, q_ids, m_ids)
        out = pd.DataFrame({"cid": np.append(q_ids, m_ids), "links": np.append(q_links, m_links), "hub": np.append(q_hub, m_hub)})
        return out[(out["links"] > 0) | (out["cid"] != out["hub"])]

    return asks.groupBy("p", "qb", "mb").cogroup(holds.groupBy("p", "qb", "mb")).applyInPandas(match, "cid long, links long, hub long")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, root_share: int = ROOT_SHARE
) -> DataFrame:
    """(id, n_links, component_id, kept) per row."""
    # single-precision components travel as such; all arithmetic is double
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    usable = (
        F.col("id").isNotNull()
        & (F.size("x") > 0)
        & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        & F.exists("x", lambda e: e != 0)
    )
    v = v.select("id", "x", F.when(usable, F.xxhash64("x")).alias("cid"))
    classes = v.where("cid is not null").groupBy("cid").agg(F.first("x").alias("x"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    classes = store(classes, "vector-classes")
    sizes = classes.groupBy(F.size("x").alias("dim")).count().orderBy("dim").collect()  # a row a length
    found = None
    for r in sizes:
        if r["count"] == 1:
            continue
        own = store(_found(classes.where(F.size("x") == r["dim"]), r["dim"], kind, threshold, sample, root_share), "vector-links")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "cid long, links long, hub long")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("cid").alias("u"), F.col("hub").alias("v")))
    d = classes.drop("x").join(counts, "cid", "left").join(labels, F.col("cid") == F.col("node"), "left")
    d = d.select("cid", "least_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    least = d.groupBy("component").agg(F.min("least_id").alias("component_id"))
    d = d.join(least, "component").select("cid", "n_links", "component_id")
    out = v.select("id", "cid").join(d, "cid", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")
    )
