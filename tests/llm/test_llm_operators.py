"""The dealt operators against brute force and exact round trips, odd inputs included."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyfold.llm import components, mixing, near_copies, packing, quality_classifier, quality_rules, simhash, token_binary, toxicity, url_filters, vector_dedup, warc
from keyfold.llm.queries import EXPLICIT, op1_warc, op2_url_filters, op5_vector_dedup, tokenizer_path
from keyfold.llm.tokenization import Encoder
from keyfold.sources.shared import new_path, store

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "one", "a  b\t c", "é ü ñ ß 日本 🙂", "it's we'll\r\n x", "<|endoftext|> a", "word " * 3000, "ab cd ef gh ij kl mn op " * 4, "\x1c\x85 \xa0 x\u2003 y", "Tail  "]
EXTRA = "doc_id long, text string, `__id` string, id int, fp int, value int, score double, source string, lang string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Odd texts, repeated rows, a null id and columns whose names the operators use inside."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "ab cd ef".split() for b in "xyzuvw"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    rows = [(i, t, "x", 1, 2, 3, 0.5, None if i % 11 == 0 else f"src{i % 3}", "en", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], rows[1], (500, texts[25], *rows[25][2:]), (None, texts[26], *rows[26][2:])]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="session")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_equals_the_library(special_as_text):
    """Texts one by one, in small and in large batches, with and without strings of added tokens read as such."""
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = special_as_text
    rng = random.Random(1)
    alphabet = list("aabcé .,'\n\t  1²") + ["\u2003", "\x1c", "日", "'s", "🙂", "\x85", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" ".join(rng.choice(["ab", "ab,", "é", "don't", "x'", "x''y", "ß&&&", "日.", "-", "a.\nB", "ª!"]) for _ in range(30)) for _ in range(300)]
    enc = Encoder(tokenizer_path(), special_as_text, max_known=40)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert (50256 in [i for ids in want for i in ids]) != special_as_text
    for size in (1, 13, len(texts)):
        got = [ids.tolist() for i in range(0, len(texts), size) for ids in enc.encode_batch(pa.array(texts[i : i + size], pa.string()))]
        assert got == want
    assert list(enc.encode_batch(pa.array([], pa.string()))) == []


def test_warc_round_trip(spark):
    big = "".join(random.Random(5).choice("abcdefghij\r\n") for _ in range(300_000))
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n0\r\n\r\n"
    htmls = [None, "", "é" * 9000, big, big, tricky, "same", "same", "same", "last"]
    rows = [(i, f"http://a/{i}\r\nX: y" if i else None, h, 7) for i, h in enumerate(htmls)] + [(7, "http://a/7", "same", 7), (None, "u", "nul", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id int")
    d = pages.withColumn("payload", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")))
    path = new_path(spark, "warc")
    warc.write_archive(d, path, "page_id", "url", "payload", segment_bytes=50_000, chunk_bytes=1000, file_bytes=200_000)
    read = warc.read_archive(spark, path)
    got = read.collect()
    assert all(r.complete for r in got) and len(got) == len(rows)
    assert read.where("warc_type = 'response' and not digest_ok").count() == 0
    narrow = read.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.expr("if(digest_ok, payload_digest, null)")}).drop("payload")
    found = sorted(((r.row_id, r.warc_type, r.refers_row, r.payload_bytes, r.digest) for r in warc.resolve(store(narrow, "w")).collect()), key=repr)
    largest = {}
    for i, _, h, _ in rows:
        largest[h or ""] = max(i if i is not None else -1, largest.get(h or "", -1))
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        keep = i is None or largest[h or ""] == i
        digest = "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        want.append((None if i is None else str(i), "response" if keep else "revisit", None if keep else str(largest[h or ""]), len(b), digest))
    assert found == sorted(want, key=repr)
    assert read.where("row_id = '4'").first().payload == big.encode()
    segments = warc.read_records(spark, path).where("segment_number is not null")
    assert segments.count() > 6
    broken = warc.reassemble(segments.where("segment_number <> 2"))
    assert broken.where("complete").count() == 0
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


def test_warc_query(spark, tmp_path):
    """The query itself: segments, revisits, nulls; without reassembly or with a lost segment it fails."""
    rng = random.Random(4)
    same, long = "x" * 6000, "".join(rng.choice("abc\r\n é") for _ in range(20_000))
    htmls = [same, long, None, "", same, "short", long, "short", same]
    spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in op1_warc(spark, str(tmp_path)).collect()}
    for i, h in enumerate(htmls):
        b = (h or "").encode()
        last = max(j for j, x in enumerate(htmls) if (x or "") == (h or ""))
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.complete) == (len(b), digest, "response" if i == last else "revisit", None if i == last else last, True)
    path = new_path(spark, "warc")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet").withColumn("payload", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")))
    warc.write_archive(pages, path, "page_id", "url", "payload", chunk_bytes=1024, segment_bytes=4096)
    read = warc.read_records(spark, path)
    assert read.where("warc_type = 'continuation'").count() >= 6
    lost = {r.row_id: r.complete for r in warc.reassemble(read.where("segment_number is not null and segment_number <> 2")).collect()}
    assert lost == {"6": False, "8": False}


def test_url_rules(spark):
    urls = ["https://a.example.org/en/12", "http://EXAMPLE.org/es/x?q", "http://x.org", "http://x.org/", "http://b.com/fr/1#t", "http://b.com/de/1", "http://notorg/", "no scheme", None, "http://myexample.org/es/", "ftp://h?x://y/z", "http://" + "a." * 3000 + "org/x"]
    d = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    none = url_filters.mine_rules(d.limit(0).withColumn("block", F.lit(True)))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(d, EXPLICIT, none).collect()}
    assert got[0] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[1] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("x.org", "", None, "allow") and got[3] == ("x.org", "/", "org/", "allow")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6] == ("notorg", "/", None, "allow") and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9][2] == "org/" and got[10] == ("h", "", None, "allow") and got[11][2] == "org/"
    assert url_filters.judge(d.limit(0), EXPLICIT, none).count() == 0


def test_association_rules_are_mined_and_matched(spark):
    rows = [(f"http://h{i}.net/{'casino/win' if i % 4 == 0 else 'news'}/{i}", i % 4 == 0 and i % 20 != 0) for i in range(200)]
    rules = url_filters.mine_rules(spark.createDataFrame(rows, "url string, block boolean"), min_count=10)
    mined = {tuple(r.antecedent): r.confidence for r in rules.collect()}
    assert mined["p:casino",] == pytest.approx(0.8) and all("p:news" not in k for k in mined)
    d = spark.createDataFrame([(1, "http://new.net/win/casino/9"), (2, "http://new.net/news/9"), (3, None), (1, "http://new.net/win/casino/9")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in url_filters.judge(d, [], rules).collect()) == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow")]
    by = {r.decided_by: r["count"] for r in op2_url_filters(spark, SF).groupBy("decided_by").count().collect()}
    assert sum(by.values()) == spark.read.parquet(f"{SF}/pages.parquet").count() and by["association"] > 0 and by["list"] > 0


def test_association_rules_with_a_high_base_rate_and_many_tokens(spark):
    """Most URLs are block, and one rule needs four tokens."""
    rows = [(f"https://a{i}.test/bad/x{'yz'[i % 2]}", True) for i in range(200)] + [(f"https://b{i}.test/fine", False) for i in range(60)]
    for i in range(40):
        own = ["s", "t", "u", "v"]
        rows.append(("https://h.org/" + "/".join(own), True))
        rows += [("https://h.org/" + "/".join(own[:k] + own[k + 1 :]), False) for k in range(4)]
    assert 2 * sum(b for _, b in rows[:260]) > 260
    high = url_filters.mine_rules(spark.createDataFrame(rows[:260], "url string, block boolean"))
    assert ["p:bad"] in [r.antecedent for r in high.collect()]
    four = url_filters.mine_rules(spark.createDataFrame(rows[260:], "url string, block boolean"))
    assert ["p:s", "p:t", "p:u", "p:v"] in [r.antecedent for r in four.collect()]


def auc(y, p):
    rank = np.argsort(np.argsort(p)) + 1
    n1 = sum(y)
    return (rank[np.array(y) == 1].sum() - n1 * (n1 + 1) / 2) / n1 / (len(y) - n1)


def test_toxicity_windows_against_a_plain_pass():
    """Worst windows, word scores and document scores by loops over strings."""
    rng = random.Random(12)
    scores = [[rng.uniform(-1, 1) for _ in range(rng.choice([1, 2, 4, 5, 6, 11]))] for _ in range(40)]
    flat, windows = np.array([x for own in scores for x in own]), toxicity.Windows(np.array(list(map(len, scores))))
    best, _ = windows.worst(flat)
    at, owner = windows.places(flat)
    first = 0
    for i, own in enumerate(scores):
        plain = [sum(own[i : i + 5]) / len(own[i : i + 5]) for i in range(max(1, len(own) - 4))]
        assert best[i] == pytest.approx(max(plain))
        start = first + plain.index(max(plain))
        assert at[owner == i].tolist() == list(range(start, start + min(5, len(own))))
        first += len(own)
    model = toxicity.Model(np.random.default_rng(0).normal(size=toxicity.BUCKETS).astype(np.float32), 0.3)

    def word(w):
        data = b"<" + w.encode() + b">"
        grams = []
        for n in (3, 4, 5):
            for i in range(len(data) - n + 1):
                h = n * 0x9E3779B97F4A7C15 % 2**64
                for byte in data[i : i + n]:
                    h = (h ^ byte) * 0x100000001B3 % 2**64
                grams.append((h ^ h >> 32) % toxicity.BUCKETS)
        h = sum((byte + 1) * 0x100000001B3 ** (i + 1) for i, byte in enumerate(data)) % 2**64
        return np.mean([model.contribution[g] for g in [*grams, (h ^ h >> 29) % toxicity.BUCKETS]])

    texts = ["one two, three", "a b c d e f", "Zwölf (Boxkämpfer) jagen Viktor quer über den großen Sylter Deich", "", None]
    for text, got in zip(texts, toxicity.Scorer(model).scores(texts)):
        own = [word(w.strip(toxicity.STRIP)) for w in (text or "").lower().split()]
        windows = [np.mean(own[i : i + 5]) for i in range(max(1, len(own) - 4))] if own else [0.0]
        assert got == pytest.approx(1 / (1 + np.exp(-max(windows) - 0.3)), rel=1e-5)


def test_toxicity_gradients():
    rng = np.random.default_rng(3)
    bags = toxicity.Bags(rng.integers(0, 9, 40), np.sort(rng.integers(0, 12, 40)), np.bincount(np.arange(12)) * 5.0)
    params = [rng.normal(size=(9, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)]
    owner = np.repeat(np.arange(6), 3)
    rest = rng.integers(0, 12, 18), owner, rng.uniform(0, 1, 6), rng.uniform(1, 3, 6), 0.3
    _, grads = bags.loss(params, *rest)
    for p, g in zip(params, grads):
        for i in np.ndindex(p.shape):
            old, step = p[i], 1e-6
            p[i] = old + step
            up = bags.loss(params, *rest)[0]
            p[i] = old - step
            down = bags.loss(params, *rest)[0]
            p[i] = old
            assert (up - down) / (2 * step) == pytest.approx(g[i], abs=1e-6)


def test_toxicity_training_rows_are_bounded(spark, monkeypatch):
    """Repeated ids, null texts and long texts; no more rows or bytes than asked for."""
    rows = [(1, None, 1), (1, "bad word", 1), (1, "bad word", 1), (2, "fine", 0), (2, "x" * 1000, 0), (None, "y", 1)] + [(i, f"text {i}", i % 2) for i in range(10, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = d.select("doc_id", "toxic")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append((texts, y)))
    for more in ({}, {"max_rows": 7}, {"max_bytes": 40}, {"max_bytes": 0}):
        toxicity.train(d, labels, **more)
    assert sorted(seen[0][0]) == sorted(["", "bad word", "fine", "x" * 1000] + [f"text {i}" for i in range(10, 40)]) and len(seen[1][0]) == 7
    assert all(len(t) == len(y) for t, y in seen) and sum(map(len, seen[2][0])) <= 40 and sum(map(len, seen[3][0])) == 0


def test_toxicity_finds_unseen_spellings(spark, docs):
    rng = random.Random(0)
    usual, bad = [a + b + c for a in "lo mi ra te".split() for b in "na po ki".split() for c in ("", "s", "ra")], ["grumpfeld", "snarkbile", "blathmor"]

    def doc(toxic, words):
        out = [rng.choice(usual) for _ in range(rng.randint(10, 150))]
        for _ in range(3 * toxic):
            out.insert(rng.randrange(len(out)), rng.choice(words))
        return " ".join(out)

    train = [(i, doc(i % 4 == 0, bad), int(i % 4 == 0)) for i in range(400)]
    d = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = toxicity.train(d, d.select("doc_id", "toxic"))
    scorer = toxicity.Scorer(model)
    y = [int(i % 3 == 0) for i in range(90)]
    assert auc(y, scorer.scores([doc(t, ["grumpfeldd", "snarkkbile", "xblathmor"]) for t in y])) > 0.97
    assert len(scorer.scores([None, ""])) == 2
    got = toxicity.score(docs, model)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.train(d, d.select("doc_id", "toxic").limit(0))
    assert toxicity.score(docs, empty).where("score <> 0.5").count() == 0


def test_quality_discriminant(spark, docs):
    rng = random.Random(2)

    def doc(good):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(15, 200))]
        return " ".join(words) if good else " ".join(w + "***" if rng.random() < 0.7 else w.upper() for w in words)

    rows = [(i, doc(i % 5 != 0), int(i % 5 != 0)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_classifier.fit(quality_classifier.measure(d.where("doc_id < 300")), d.select("doc_id", "quality"))
    held = quality_classifier.score(quality_classifier.measure(d.where("doc_id >= 300")), model).join(d, "doc_id").collect()
    assert np.mean([(r.score >= 0.3) == r.quality for r in held]) > 0.97
    x = np.array([quality_classifier.statistics(r[1]) for r in rows[:300]])
    y = np.array([r[2] for r in rows[:300]])
    assert np.allclose(model.mean, [x[y == 0].mean(0), x[y == 1].mean(0)])
    # the posterior by plain linear algebra, without the cached factors
    covs = [np.linalg.inv(model.whiten[k]) @ np.linalg.inv(model.whiten[k]).T for k in (0, 1)]
    log = [-0.5 * (v := x[7] - model.mean[k]) @ np.linalg.solve(covs[k], v) - 0.5 * np.linalg.slogdet(covs[k])[1] + np.log((y == k).mean()) for k in (0, 1)]
    assert model.scores(x[7:8])[0] == pytest.approx(1 / (1 + np.exp(log[0] - log[1])))
    got = quality_classifier.score(quality_classifier.measure(docs), model)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_classifier.filtered(docs, model, 0.0).count() == docs.count()
    assert quality_classifier.measure(docs.limit(0)).count() == 0


def grouped(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 24))
    near = [base[i % 40] + rng.normal(size=24) * s for i, s in zip(range(300), rng.uniform(0.05, 0.4, 300))]
    hot = [base[50] + rng.normal(size=24) * 0.05 for _ in range(400)]
    x = [*base, *near, *hot, *[base[60]] * 50, base[60] * 3]
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0, 2.0]]
    rows += [(5000 + i, r, "x") for i, r in enumerate(odd)] + [(None, rows[0][1], "x"), rows[3]]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cid string")
    got = vector_dedup.near_duplicates(d)
    unit = np.array([*x, x[3]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    comp = grouped(len(unit), lambda i, j: link[i, j])
    want = sorted([(i if i < len(x) else 3, int(link[i].sum()), comp[i] if comp[i] < len(x) else 3) for i in range(len(unit))])
    rows_got = got.collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows_got if r.vec_id is not None and r.vec_id < 5000) == want
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in rows_got if r.vec_id is not None and r.vec_id >= 5000)
    assert len(rows_got) == len(rows)
    assert vector_dedup.near_duplicates(d.limit(0)).count() == 0
    assert vector_dedup.near_duplicates(d.where("vec_id >= 5000")).count() == len(odd)


def check_vectors(d, rows, got, threshold=0.95):
    """Links and components of ``rows`` (id, vector) against all cosines, length by length."""
    want = {}
    for length in {len(v) for _, v in rows}:
        own = [r for r in rows if len(r[1]) == length]
        unit = np.array([v for _, v in own], float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        link = unit @ unit.T >= threshold
        np.fill_diagonal(link, False)
        comp = grouped(len(own), lambda i, j: link[i, j])
        want |= {own[i][0]: (int(link[i].sum()), own[comp[i]][0], comp[i] == i) for i in range(len(own))}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == want
    return sum(w[0] for w in want.values())


@pytest.mark.parametrize("rank", [4, 8, 64])
def test_vector_links_lose_none(spark, rank):
    """Planted links over many cells; where vectors lie in few directions, most neighbours are across a boundary."""
    rng = np.random.default_rng(rank)
    basis = np.linalg.qr(rng.normal(size=(64, 64)))[0][:rank]
    base = rng.normal(size=(1500, rank))
    near = base[rng.integers(0, 1500, 500)] + rng.normal(size=(500, rank)) * rng.uniform(0.1, 0.35, (500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]) @ basis)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert vector_dedup.cells_for(len(rows), 1) == 44
    assert check_vectors(d, rows, vector_dedup.near_duplicates(d, root_share=1)) > 200


def test_vector_query_with_planted_links(spark, tmp_path):
    """The query over single-precision vectors of three lengths."""
    rng = np.random.default_rng(7)
    rows = []
    for length, n in ((64, 600), (8, 90), (3, 2)):
        x = rng.normal(size=(n, length))
        x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, length)) * 0.1
        rows += [(len(rows) + i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert check_vectors(None, rows, op5_vector_dedup(spark, str(tmp_path))) > 600


def test_many_cells_are_fitted_by_groups(monkeypatch):
    monkeypatch.setattr(vector_dedup, "MANY", 16)
    assert vector_dedup.cells_for(10_000, 1) == 100
    x = np.random.default_rng(1).normal(size=(800, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vector_dedup.fit(x, 100, 0.95)
    assert 100 <= len(index.centres) <= 112 and np.allclose(np.linalg.norm(index.centres, axis=1), 1)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (3, None)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    pairs = {frozenset(e) for e in edges if None not in e and e[0] != e[1]}
    ids = sorted({x for p in pairs for x in p})
    comp = grouped(len(ids), lambda i, j: frozenset((ids[i], ids[j])) in pairs)
    assert got == {ids[i]: ids[c] for i, c in enumerate(comp)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, docs):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0]))
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = grouped(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert got == sorted(((r[0], format(f, "016x"), rows[c][0]) for r, f, c in zip(rows, fps, comp)), key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({rows[c][0] for c in comp}) and sum(r.doc_id is None for r in kept) == 1


@pytest.mark.parametrize("hot", [0, 3, 64, 10_000])
def test_fingerprint_links_lose_none(spark, hot):
    """Whether every entry of the segment tables is hot, some are, or none is."""
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(1) << rng.randrange(64)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    low = rng.getrandbits(32)  # one segment in common and the other by chance: candidates that the distance rejects
    fps |= {rng.getrandbits(32) << 32 | low for _ in range(80)} | {0, 1, 3, 1 << 63, (1 << 64) - 1}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), hot)
    got = {r.node: r.component for r in components.components(links).collect()}
    comp = grouped(len(fps), lambda i, j: ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2)
    assert [got.get(x, x) for x in fps] == [fps[c] for c in comp]
    assert links.where("bit_count(u ^ v) > 2").count() == 0
    if hot == 10_000:  # then every pair is a link of its own
        pairs = {(max(a, b), min(a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
        assert {(r.u, r.v) for r in links.collect()} == pairs


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    long = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    d = spark.createDataFrame([(1, long[0], 7), (1, long[1], 7), (1, long[0], 7), (2, long[0], 7), (3, long[2], 7)], "doc_id long, text string, fp int")
    assert sorted((r.doc_id, r.text) for r in simhash.one_of_each(d).collect()) == [(1, long[0]), (1, long[1]), (3, long[2])]
    assert simhash.one_of_each(d).columns == d.columns


def plain_similar(x, y, size=5):
    """Jaccard similarity of two texts' shingles, as strings."""
    sides = []
    for text in (x, y):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sides.append({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    return len(sides[0] & sides[1]) / len(sides[0] | sides[1])


def near_texts(rng, groups):
    """Texts and copies of them with a few words changed, added or left out; some only similar by half."""
    words = [f"{a}{b}{c}" for a in "ab cd ef gh".split() for b in "xyzuvw" for c in ("", "1", "22", "n")]
    out = []
    for copies in groups:
        base = [rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randint(40, 160))]
        out.append(" ".join(base))
        for i in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 12])):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1])] = [rng.choice(words)] * rng.choice([0, 1, 1])
            out.append((" " if i % 3 else "\n").join(own).title() if i % 4 == 0 else " ".join(own))
    return out


@pytest.mark.parametrize("hot", [0, 4, 64])
def test_near_copies_against_brute_force(spark, hot):
    """Components of all pairs that are near in a fingerprint and similar; crowded entries lose none of them."""
    rng = random.Random(hot)
    texts = near_texts(rng, [0] * 20 + [1] * 10 + [3] * 5 + [30, 60]) + ODD
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[9], "x", 1), (4, texts[4], "x", 1), (None, texts[2], "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, `__id` string, id int").repartition(3)
    prints = [near_copies.bags(t)[1] for _, t, *_ in rows]
    bits = [int.from_bytes(p, "big") for p in prints]

    def linked(i, j):
        near = (bits[i] ^ bits[j]).bit_count() <= 11
        return near and plain_similar(rows[i][1], rows[j][1]) >= 0.8

    n = len(rows) - 1  # the row without an id takes no part
    comp = grouped(n, linked)
    groups = {}
    for i, c in enumerate(comp):
        groups.setdefault(c, []).append(rows[i][0])
    got = near_copies.one_of_each(d, hot=hot).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(min(g) for g in groups.values())
    assert sum(r.doc_id is None for r in got) == 1 and got[0].__fields__ == d.columns
    exact = grouped(n, lambda i, j: plain_similar(rows[i][1], rows[j][1]) >= 0.8)
    assert len(set(comp)) - len(set(exact)) <= 2  # what the fingerprints do not meet
    assert near_copies.one_of_each(d.limit(0)).count() == 0


def test_near_copies_split_no_group_at_the_centres(spark):
    """A chain: each text is similar to the next ones only, so most links do not touch a centre."""
    words = [f"w{i}" for i in range(300)]
    d = spark.createDataFrame([(i, " ".join(words[i : i + 100])) for i in range(0, 150)], "doc_id long, text string")
    assert plain_similar(" ".join(words[:100]), " ".join(words[12:112])) < 0.8
    for hot in (0, 64):
        assert [r.doc_id for r in near_copies.one_of_each(d, hot=hot).collect()] == [0]


def test_near_copies_ask_for_every_near_value(spark):
    """Eleven bits apart, one in one segment and two in each other: only a value with one bit more meets the other."""
    rng = random.Random(5)
    rows, want = [], set()
    for n in range(60):
        bits = [rng.getrandbits(64), rng.getrandbits(64)]
        other = list(bits)
        for i, (half, first, length) in enumerate(near_copies.SEGMENTS):
            for k in rng.sample(range(length), 1 if i == n % 6 else 2):
                other["ab".index(half)] ^= 1 << first + k
        rows += [(2 * n, *bits), (2 * n + 1, *other)]
        want.add((2 * n + 1, 2 * n))
    rows = [(n, *(x - (1 << 64) if x >> 63 else x for x in x)) for n, *x in rows]
    d = spark.createDataFrame(rows, "cid long, a long, b long")
    got = near_copies._pairs(near_copies._keys(d, True), near_copies._keys(d, False))
    assert {(r.u, r.v) for r in got.collect()} == want


def test_near_copies_do_not_compare_what_cannot_be_similar(spark):
    """A large group of texts near to each other, a few of which are similar: those meet, and hardly any others."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(240):
        own = list(base)
        for at in rng.sample(range(2, 118), 6):
            own[at] = f"x{i}y{at}"
        texts.append(" ".join(own))
        if i % 20 == 0:
            own[60] = f"z{i}"
            texts.append(" ".join(own))
    prints = [near_copies.bags(t)[1] for t in texts]
    shingles = [near_copies.shingles(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (int.from_bytes(prints[i]) ^ int.from_bytes(prints[j])).bit_count() <= 11]
    similar = {(i, j) for i, j in near if near_copies.similarity(shingles[i], shingles[j]) >= 0.8}
    halves = [tuple(int.from_bytes(p[k : k + 8], signed=True) for k in (0, 8)) for p in prints]
    met = spark.createDataFrame([(i, *x) for i, x in enumerate(halves)], "cid long, a long, b long")
    sets = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(shingles)], "cid long, s binary")
    labels = spark.createDataFrame([], "node long, component long")
    got = {(r.u, r.v) for r in near_copies._rare_pairs(met, sets, labels, 0.8).collect()}
    assert len(near) > 4_000 and similar and similar <= got and len(got) < len(near) / 4


def test_perhaps_loses_none_and_keeps_few_others(spark, monkeypatch):
    d = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id")).alias("s"))
    wanted = store(d.where("k % 20 = 0"), "wanted")
    for longs, others in ((1 << 18, 0.1), (1, 1.0)):
        monkeypatch.setattr(near_copies, "MAX_LONGS", longs)
        got = near_copies._perhaps(d, wanted, "k", "s")
        assert got.count() == 20_000 and got.where("k % 20 = 0 and not __perhaps").count() == 0
        assert got.where("k % 20 <> 0 and __perhaps").count() <= 19_000 * others


def test_edf_stays_within_one_block():
    rng = random.Random(6)
    for shares in [[1], [1, 1], [4, 3, 3, 2, 2] + [1] * 15, [50, 1, 1], *[[rng.randint(1, 40) for _ in range(rng.randint(2, 12))] for _ in range(20)]]:
        slots, period, done = mixing.edf_template(shares), sum(shares), [0] * len(shares)
        assert [slots.count(i) for i in range(len(shares))] == shares
        for t, s in enumerate(slots, 1):
            done[s] += 1
            assert all(abs(n * period - t * k) < period for n, k in zip(done, shares))


def test_mixing_against_a_plain_schedule(spark, docs):
    shares = {"src0": 3, "src1": 2}
    got = mixing.mix(docs, shares, block_docs=4)
    assert set(docs.columns) < set(got.columns)
    rows = [(r.doc_id, r.source, r.mix_position) for r in got.collect()]
    assert sorted(r[2] for r in rows) == list(range(len(rows)))
    names = sorted({r[1] for r in rows if r[1]}) + [None]
    md5 = lambda i: hashlib.md5(str(i).encode()).hexdigest() if i is not None else "~"
    queues = {n: sorted((md5(r[0]), r[0] is None, r[0] or 0) for r in rows if r[1] == n) for n in names}
    template, out, t = mixing.edf_template([shares.get(n, 1) for n in names]), [], 0
    while any(queues.values()):
        name = names[template[t % len(template)]]
        out += [(name, x) for x in queues[name][:4]]
        queues[name], t = queues[name][4:], t + 1
    assert [(s, (md5(i), i is None, i or 0)) for i, s, _ in sorted(rows, key=lambda r: r[2])] == out
    tables = mixing.mix(docs, shares, block_docs=4, max_cells=0)
    assert tables.columns == got.columns
    key = ["doc_id", "text", "mix_slot", "mix_position", "mix_on_target"]
    assert sorted(tables.select(key).collect(), key=repr) == sorted(got.select(key).collect(), key=repr)
    assert mixing.mix(docs.limit(0), shares).count() == 0
    assert mixing.in_order(docs, shares).columns == docs.columns
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src0": 0})


def test_packing(spark, docs, tokenizer):
    got = packing.pack(docs, tokenizer_path(), end_id=2, keep_ids=True).collect()
    want = sorted([ids_of(tokenizer, r.text, 2).tobytes() for r in docs.collect()])
    by_sequence, whole = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault((r.doc_id, r.piece, r.start), []).append(r.ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    docs_back = []
    for doc_id in {k[0] for k in whole}:
        parts = [v for k, v in sorted(whole.items(), key=lambda x: x[0][2]) if k[0] == doc_id]
        docs_back += [b"".join(p[i] for p in parts) for i in range(len(parts[0]))]
    assert sorted(docs_back) == want
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_packing_search_improves_and_keeps_every_piece():
    rng = np.random.default_rng(0)
    histogram = dict(zip(*(x.tolist() for x in np.unique(rng.integers(100, 600, 20_000), return_counts=True))))
    before = packing.best_fit_decreasing(histogram, 1024)
    after = packing.local_search(before.copy(), 1024)
    assert sum(after.values()) < sum(before.values()) and max(map(sum, after)) <= 1024
    counts = {}
    for kind, n in after.items():
        for x in kind:
            counts[x] = counts.get(x, 0) + n
    assert counts == histogram
    assert [packing.cut(n, 4) for n in (1, 4, 5, 9)] == [[(0, 1)], [(0, 4)], [(0, 1), (1, 4)], [(0, 1), (1, 4), (5, 4)]]


def test_token_files(spark, docs, tokenizer, tmp_path):
    path = new_path(spark, "tokens")
    token_binary.write_tokens(docs, path, tokenizer_path(), sequence_length=16, batch_rows=4, shard_tokens=3000)
    got = token_binary.with_starts(token_binary.read_tokens(spark, path)).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = ids_of(tokenizer, text, 0)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    names = [x for x in __import__("pathlib").Path(path.removeprefix("file://")).iterdir() if x.name.startswith("part-")]
    assert len(names) > 2
    for name in names:
        with pa.memory_map(str(name)) as source:
            reader = pa.ipc.open_file(source)
            before = pa.total_allocated_bytes()
            batches = [reader.get_batch(i) for i in range(reader.num_record_batches)]
            assert pa.total_allocated_bytes() - before < 4096  # mapped, not copied
            assert all(b.num_rows == 4 for b in batches[:-1]) and batches[0].schema.field("ids").type.list_size == 16
    empty = new_path(spark, "tokens")
    token_binary.write_tokens(docs.limit(0), empty, tokenizer_path())
    assert token_binary.read_tokens(spark, empty).count() == 0


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams, inside = {}, set()
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            inside.update(i + k for i in at for k in range(8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark, docs):
    entries = quality_rules.ledger(docs)
    assert sorted(tuple(r) for r in entries.select(quality_rules.MEASURES).collect()) == sorted(plain_measures(r.text) for r in docs.collect())
    table = {r.rule: r for r in quality_rules.ablation(entries, quality_rules.STANDARD).collect()}
    bits = [r.failure_bits for r in entries.collect()]
    mask = quality_rules.STANDARD.mask
    for i, (rule, _) in enumerate(quality_rules.RULES):
        if rule in table:
            assert (table[rule].n_failed, table[rule].n_only_this) == (sum(b >> i & 1 for b in bits), sum(b & mask == 1 << i for b in bits))
    kept = quality_rules.filtered(docs, quality_rules.STANDARD)
    assert kept.columns == docs.columns and kept.count() == sum(b & mask == 0 for b in bits)
    assert quality_rules.ledger(docs.limit(0)).count() == 0
    assert [r.n_docs for r in quality_rules.ablation(entries.limit(0), quality_rules.BASE).collect()] == [0, 0]
