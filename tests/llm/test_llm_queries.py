"""The registered queries without SQL, by name: columns, digests, thresholds and held-out rows against plain Python."""

import itertools
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from keyfold.llm import packing, queries

from test_llm_operators import auc, grouped, plain_fingerprint

SF, LABELLED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def ids(documents):
    """Ids of every whole text by the library as it comes."""
    t = Tokenizer.from_file(queries.tokenizer_path())
    return {d["doc_id"]: t.encode(d["text"] or "", add_special_tokens=False).ids for d in documents}


@pytest.mark.parametrize("name, label, modulus, remainder, least, unseen", [("op3_toxicity", "toxic", 3, 1, 0.7, 0.6), ("op4_quality_classifier", "quality", 5, 0, 0.3, 0.9)])
def test_classifier_queries(spark, name, label, modulus, remainder, least, unseen):
    """On a small table: toxic words of the held-out rows are mostly not among those of three dozen labelled ones."""
    documents = pq.read_table(f"{LABELLED}/documents.parquet", columns=["doc_id"]).to_pylist()
    df = queries.QUERIES[name](spark, LABELLED)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    assert dict(df.dtypes)["score"] == "double" and dict(df.dtypes)["predicted"] == "int" and dict(df.dtypes)["held_out"] == "boolean"
    got = {r.doc_id: r for r in df.collect()}
    assert sorted(got) == sorted(d["doc_id"] for d in documents)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == remainder) for i, r in got.items())
    assert all(r.predicted == (r.score >= least) and 0 <= r.score <= 1 for r in got.values())
    labels = [(r["doc_id"], r[label]) for r in pq.read_table(f"{LABELLED}/labels.parquet").to_pylist() if r[label] is not None and r["doc_id"] in got]
    for held in (False, True):
        own = [(y, got[i].score) for i, y in labels if got[i].held_out == held]
        assert 0 < sum(y for y, _ in own) < len(own)
        assert auc([y for y, _ in own], np.array([s for _, s in own])) > (unseen if held else 0.9)


def test_classifiers_do_not_see_held_out_labels(spark, documents, tmp_path):
    """Turning every held-out label round changes no score."""
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    pq.write_table(pq.read_table(f"{SF}/documents.parquet"), f"{tmp_path}/documents.parquet")
    crc = labels["doc_id"].map(lambda i: zlib.crc32(str(i).encode()))
    labels.loc[crc % 3 == 1, "toxic"] = 1 - labels["toxic"]
    labels.loc[crc % 5 == 0, "quality"] = 1 - labels["quality"]
    labels.to_parquet(f"{tmp_path}/labels.parquet")
    for name in ("op3_toxicity", "op4_quality_classifier"):
        scores = [{r.doc_id: r.score for r in queries.QUERIES[name](spark, sf).collect()} for sf in (SF, str(tmp_path))]
        assert scores[0] == pytest.approx(scores[1], abs=1e-9)


def test_packing_query(spark, documents, ids):
    df = queries.op6_packing(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(df.columns)
    got = df.collect()
    want = {}
    for i, own in ids.items():
        own = np.array([*own, 2], "<u4")
        first = len(own) % 1024 or min(len(own), 1024)
        cuts = [0, *range(first, len(own) + 1, 1024)]
        want |= {(i, p): (a, b - a, zlib.crc32(own[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    fills = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 1024
    assert len(fills) <= -(-sum(len(x) + 1 for x in ids.values()) // 1024) + 1  # one more than no packing can do without


def fewest_bins(lengths, capacity):
    """By trying every way to share out the pieces."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in {x: k for k, x in enumerate(bins)}.values():
            if bins[b] + lengths[i] <= capacity:
                place(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_packing_against_all_packings():
    """Few pieces: best fit with the search is at most a bin above the fewest there can be, and mostly at it."""
    rng = np.random.default_rng(5)
    over = 0
    for _ in range(60):
        lengths = sorted((int(x) for x in rng.integers(1, 12, rng.integers(3, 10))), reverse=True)
        bins = packing.local_search(packing.best_fit_decreasing({n: lengths.count(n) for n in set(lengths)}, 12), 12)
        got, least = sum(bins.values()), fewest_bins(lengths, 12)
        assert least <= got <= least + 1
        over += got - least
        pieces = sorted(itertools.chain.from_iterable(k * n for k, n in bins.items()), reverse=True)
        assert pieces == lengths
    assert over <= 3


def test_simhash_query(spark, documents):
    got = queries.op7_simhash(spark, SF).collect()
    docs = sorted(documents, key=lambda d: d["doc_id"])
    fps = [plain_fingerprint(d["text"]) for d in docs]
    comp = grouped(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert sorted(map(tuple, got)) == [(d["doc_id"], format(f, "016x"), docs[c]["doc_id"]) for d, f, c in zip(docs, fps, comp)]
    assert got[0].__fields__ == ["doc_id", "fingerprint", "component_id"]


def test_token_query(spark, ids):
    df = queries.op9_token_binary(spark, SF)
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    at, want = 0, []
    for i in sorted(ids):
        own = np.array([*ids[i], 0], "<u4")
        want.append((i, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    assert sorted(map(tuple, df.collect())) == want
