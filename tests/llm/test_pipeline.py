"""The pipeline against a plain version on a small table."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from keyfold.llm import mixing, near_copies, packing, quality_classifier, quality_rules
from keyfold.llm.queries import QUALITY_THRESHOLD, tokenizer_path
from keyfold.sources.shared import store

SF = "/root/testdata/sf0.001"


def plain(spark, sf):
    """Kept documents by plain Python, in the order of their ids."""
    from test_llm_operators import grouped, plain_measures, plain_similar

    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    names = quality_rules.MEASURES
    docs = [d for d in docs if not _rejected(dict(zip(names, plain_measures(d["text"]))))]
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    x = {d["doc_id"]: np.array(quality_classifier.statistics(d["text"])) for d in docs}
    train = [i for i in x if i in labels and zlib.crc32(str(i).encode()) % 5]
    keep = set(x) if len({labels[i] for i in train}) < 2 else _posterior(x, {i: labels[i] for i in train})
    docs = [d for d in docs if d["doc_id"] in keep]
    bits = [int.from_bytes(near_copies.bags(d["text"])[1], "big") for d in docs]
    similar = [[i > j and plain_similar(docs[i]["text"], docs[j]["text"]) >= 0.8 for j in range(len(docs))] for i in range(len(docs))]
    comp = grouped(len(docs), lambda i, j: similar[i][j] and (bits[i] ^ bits[j]).bit_count() <= 11)
    # what the fingerprints do not meet of all similar pairs: one document here
    assert len(set(comp)) - len(set(grouped(len(docs), lambda i, j: similar[i][j]))) <= 1
    return [docs[i] for i in sorted(set(comp))]


def measured(text):
    from test_llm_operators import plain_measures

    return plain_measures(text)


def _rejected(m):
    return (
        m["n_words"] < 20
        or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        or 2 * m["n_symbols"] > m["n_words"]
        or (m["n_lines"] > 3 and 2 * m["n_dup_lines"] > m["n_lines"])
    )


def _posterior(x, labels):
    by = [np.array([x[i] for i in labels if labels[i] == k]) for k in (0, 1)]
    n = sum(map(len, by))
    pooled = sum(np.cov(b.T, bias=True) * len(b) for b in by) / n
    parts = []
    for b in by:
        cov = 0.8 * np.cov(b.T, bias=True) + 0.2 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-2 * np.eye(len(cov))
        parts.append((b.mean(0), cov, np.log(len(b) / n)))

    def log(v, k):
        mean, cov, prior = parts[k]
        return prior - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (v - mean) @ np.linalg.solve(cov, v - mean)

    return {i for i, v in x.items() if 1 / (1 + np.exp(np.clip(log(v, 0) - log(v, 1), -700, 700))) >= QUALITY_THRESHOLD}


def test_pipeline_equals_plain_version(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    t = Tokenizer.from_file(tokenizer_path())
    want = {}
    for d in plain(spark, SF):
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d["doc_id"], p] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert len(got) == len(want)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= 1.05 * -(-total // 1024) + 1


@pytest.mark.parametrize("stage", [x for _, x in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(20).unionByName(docs.limit(3)).withColumn("fp", F.lit(1)).withColumn("text", F.when(F.col("doc_id") % 5 != 0, F.col("text")))
    odd = odd.unionByName(docs.limit(2).select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:]).withColumn("fp", F.lit(1)))
    odd = odd.unionByName(odd.limit(1).withColumn("text", F.repeat("text", 60)))
    out = stage(spark, odd, SF)
    rows, n = out.collect(), odd.count()
    if stage is corpus_pipeline.STAGES[-1][1]:
        assert len({(r.doc_id, r.piece, r.start, r.sequence_id, r.offset) for r in rows}) == len(rows)
        assert sum(r.piece == 0 for r in rows) == n
    else:
        assert out.columns == odd.columns
        given = [tuple(r) for r in odd.collect()]
        assert all(tuple(r) in given for r in rows)
        if stage is corpus_pipeline.rules:
            assert rows and not any(_rejected(dict(zip(quality_rules.MEASURES, measured(r.text)))) for r in rows)
        if stage is corpus_pipeline.near_duplicates:
            named = [r.doc_id for r in rows if r.doc_id is not None]
            assert len(named) == len(set(named)) and sum(r.doc_id is None for r in rows) == sum(r[0] is None for r in given)
        if stage is corpus_pipeline.mix:
            assert len(rows) == n
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_packed_prefixes_follow_the_mix(spark, monkeypatch):
    """A prefix of the sequences holds the first documents of the mix, and other shares give another one."""
    monkeypatch.setattr(packing, "SEGMENT", 8)
    text = " ".join(f"w{i}" for i in range(40))
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.when(F.col("id") < 200, "src0").otherwise("src1").alias("source"))
    d = store(d.repartition(3, "doc_id"), "mix-test")
    for shares in ({"src0": 3, "src1": 1}, {"src0": 1, "src1": 3}):
        monkeypatch.setattr(corpus_pipeline, "SHARES", shares)
        mixed = store(corpus_pipeline.mix(spark, d, SF), "mix-test")
        places = mixing.mix(d, shares, block_docs=corpus_pipeline.BLOCK_DOCS).orderBy("mix_position").collect()
        got = corpus_pipeline.pack(spark, mixed, SF).orderBy("sequence_id").collect()
        assert len(got) == 400
        for n in (64, 128, 200):
            assert {r.doc_id for r in got[:n]} == {r.doc_id for r in places[:n]}


def test_run_changes_with_the_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 16)
    found = []
    for shares in ({"src0": 9}, {"src1": 9}):
        monkeypatch.setattr(corpus_pipeline, "SHARES", shares)
        found.append({(r.doc_id, r.piece): r.sequence_id for r in corpus_pipeline.run(spark, SF).collect()})
    assert found[0].keys() == found[1].keys() and found[0] != found[1]
