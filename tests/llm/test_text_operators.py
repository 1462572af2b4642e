import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialspark.llm import bpe, langid, mixing, quality, queries, topk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as P

    path = bpe.default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.tokenizer(path), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def both(codec, texts):
    raw = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(x) for x in raw]))
    ids, _ = codec[0].encode(np.frombuffer(b"".join(raw), np.uint8), off)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [codec[1].encode_ordinary(t) for t in texts]
    assert codec[0].decode(ids) == raw


def test_bpe_hard_cases(codec):
    both(codec, ["", "'s", " 's", "a's'll 've''re'", "  \n x\n", "\n\n", " ", "a" * 3000, "ab" * 999 + " 1٣²", "é　中文 😀!!  ", "<|endoftext|>", "x\r\n\ty", "\x1c\x1d a"])
    r = random.Random(1)
    both(codec, ["".join(r.choice("ab'stmdrevl  \n\té1!?中😀\x00\xa0") for _ in range(r.randint(0, 40))) for _ in range(3000)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_bpe_any_text(texts):
    path = bpe.default_ranks()
    tok = bpe.tokenizer(path)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    raw = [t.encode() for t in texts]
    ids, ends = tok.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
    assert tok.decode(ids) == raw
    assert [np.frombuffer(e, "<i4")[-1] if e else 0 for e in ends] == [len(x) for x in raw]


def test_bpe_rows(spark, codec):
    docs = spark.createDataFrame([(1, "it's a text", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, ids string")
    rows = bpe.encode(docs, bpe.default_ranks())
    assert rows.columns == ["doc_id", "n_tokens", "ids", "piece_ends"]
    assert [r.n_tokens for r in rows.orderBy("doc_id").collect()] == [4, 0, 0]
    assert [bytes(r.decoded) for r in bpe.decode(rows, bpe.default_ranks()).orderBy("doc_id").collect()] == [b"it's a text", b"", b""]
    assert bpe.encode(docs.limit(0), bpe.default_ranks()).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"a\xffb"))], "doc_id long, text binary").select("doc_id", F.col("text").cast("binary").alias("text"))
    assert bytes(bpe.round_trip(bad, bpe.default_ranks()).first().decoded) == "a�b".encode()


def test_bpe_query(spark, codec):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in bpe.query(spark, SF).collect():
        ids = codec[1].encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_language_held_out_accuracy(spark):
    rows = langid.query(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en", 0), (2, "le chat est sur la table", "fr", 0), (3, None, "fr", 0), (4, "123 !", "en", 0), (5, "", None, 0)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "fr"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5))
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), none).count() == 0


def test_grams_by_hand():
    raw = ["Ab, c", "", "É"]
    data = "".join(raw).encode()
    off = np.append(0, np.cumsum([len(x.encode()) for x in raw]))
    bins, owner, has = langid.grams(np.frombuffer(data, np.uint8), off)
    # " ab c" has 5 + 4 + 3 n-grams, " é" has 2 + 1
    assert np.bincount(owner, minlength=3).tolist() == [12, 0, 3] and has.tolist() == [True, False, True]


def test_top_k_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([0.1, -0.3, 0.5, 1.7]) for _ in range(3)]) for i in range(90)]
    rows += [(100, None), (101, [None, 1.0, 1.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    v = topk.quantise(spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int"))
    got = topk.top_k(v, v.where("vec_id % 20 = 0"), k=7, batch=3)
    exact = {i: [int(np.floor(64 * float(np.float32(x)))) for x in e] for i, e in rows[:90]}
    want = []
    for q in range(0, 90, 20):
        best = sorted((-sum(a * b for a, b in zip(exact[q], exact[i], strict=True)), i) for i in exact if i != q)[:7]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(x) for x in got.collect()) == want
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert topk.top_k(v, v.where("vec_id = 0"), k=500).count() == 89
    assert topk.top_k(v, v.limit(0)).count() == 0 and topk.top_k(v.where("vec_id = 0"), v.where("vec_id = 0")).count() == 0


def test_large_products_stay_exact():
    a = np.array([[1 << 28, 3]], np.int64)
    assert topk._scores(a, a).tolist() == [[(1 << 56) + 9]]
    assert topk._scores(a << 10, a << 10).tolist() == [[1 << 61]]


def test_vectors_of_several_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [1.0, 1.0, 1.0]), (20, [0.5, 1.0, 3.0]), (3, [1e300, 1.0]), (4, [])]
    v = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 20 = 0"), k=2).collect())
    assert got == [(0, 1, 3, 1 << 61), (0, 2, 1, 64 * 128 + 128 * 128), (20, 1, 2, 64 * 32 + 64 * 64 + 64 * 192)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)


def test_mixing(spark):
    rows = [(i, "x" * (5 if i % 2 else 15), "a" if i % 2 else ("b" if i % 4 else None), 1) for i in range(4000)] + [(None, None, "a", 1), (7, "xxxxx", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, replica int")
    out = mixing.mix_sources(docs, {"a": 3.0, "b": 1.0}, epochs=2.0)
    size = {r.source: r.s for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("s")).collect()}
    assert None not in size and abs(size["a"] / size["b"] - 3) < 0.3
    whole = docs.select(F.sum(F.greatest(F.lit(1), F.length("text")))).first()[0]
    assert abs((size["a"] + size["b"]) / (2 * whole) - 1) < 0.1
    counts = {r.doc_id: r.n for r in out.where("source = 'a' and doc_id <> 7").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    n = np.array([counts.get(i, 0) for i in range(1, 4000, 2) if i != 7])
    assert abs(n.var() / n.mean() - 1) < 0.15  # Poisson: variance and mean agree
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys)
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mix_sources(docs, {"z": 1.0}).count() == 0
    assert mixing.mix_sources(docs).where("source is null").count() > 0


def test_quality_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.query(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [x for x in labels if x.quality == 1 and x.toxic == 0]
    bad = [x for x in labels if not (x.quality == 1 and x.toxic == 0)]
    assert sum(rows[x.doc_id].keep for x in good) >= 0.99 * len(good)
    assert sum(not rows[x.doc_id].keep for x in bad) >= 0.9 * len(bad)  # of 399 labels, few are toxic in any one language


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a fine text", "s", "en", 0), (2, None, None, None, 0), (3, "", "s", None, 0), (3, "", "s", None, 0)], "doc_id long, text string, source string, lang string, score int")
    none = quality.fit(docs, spark.createDataFrame([(1, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int"))
    out = quality.classify(docs, none).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert quality.classify(docs.limit(0), none).count() == 0


def test_sites_shrink_to_priors(spark):
    rows = [("big", "p", 0.9)] * 500 + [("big", "q", 0.9)] * 400 + [("low", "p", 0.1)] * 500 + [("low", None, 0.5)] * 300 + [("tiny", "p", 0.0)]
    got = {(r.host, r.path): r.prior for r in quality.sites(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert got["big", "p"] > 0.85 and got["low", "p"] < 0.2
    assert 0.05 < got["tiny", "p"] < 0.6  # one row moves little


def test_texts_longer_than_a_slice(codec, monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice(["ab", " ", "'s", "\n", "é", "1", "?", " don't", "  "]) for _ in range(900)), "x" * 500, " a" * 300, "short"]
    monkeypatch.setattr(bpe, "SLICE", 64)
    both(codec, texts)
    raw = texts[0].encode()
    ids, ends = codec[0].encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    monkeypatch.setattr(bpe, "SLICE", 1 << 20)
    assert ends == codec[0].encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1]
    monkeypatch.setattr(langid, "SLICE", 100)
    data = np.frombuffer(("word " * 100).encode(), np.uint8)
    bins, owner, has = langid.grams(data, np.array([0, len(data)]))
    assert has.tolist() == [True] and set(owner) == {0} and len(bins) == len(owner) > 1200
