from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.llm import language_id as L

from .helpers import awkward, empty


def page(lang, body):
    return f"<html lang='{lang}'><body><article><p>{body}</p></article></body></html>" if lang else f"<html><body><article><p>{body}</p></article></body></html>"


def test_features_of_letters_and_words():
    bucket, row = L.features(["Ab c", "", "ab", "12 - "])
    assert sorted(row.tolist()) == [0, 0, 0, 0, 0, 2, 2, 2]
    assert set(bucket[row == 2].tolist()) <= set(bucket[row == 0].tolist())


@pytest.mark.parametrize("text", ["alpha beta " * 50, "alpha,beta;" * 50, "alphabeta" * 50, "日本語。テキスト" * 40, "x" * 500 + " y"])
def test_long_texts_are_not_cut_inside_words(monkeypatch, text):
    whole = L.features([text])[0]
    monkeypatch.setattr(L, "PIECE", 64)
    import numpy as np

    parts = np.concatenate([L.features([t for _, t in g])[0] for g in L._grouped([text])])
    assert sorted(whole.tolist()) == sorted(parts.tolist())


def test_fusion_equals_brute_force(spark):
    """Softmax of likelihoods, sums by host, suffix and declared language, smoothing and fusion, row by row."""
    import math
    import random

    rng = random.Random(4)
    langs = ["a", "b", "c"]
    rows = [(k, rng.choice([None, "a", "b", "zz"]), rng.choice([None, "com", "de"]), rng.choice([None, "x.com", "y.de", "z.de"]), [0.0] * 3 if rng.random() < 0.2 else [rng.uniform(-9, 0) for _ in langs]) for k in range(80)]
    rows += [(100 + k, "a", "com", "x.com", [-1.0, -2.0, -3.0]) for k in range(70)]  # copies under one host

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    def sums(key):
        out = {}
        for r in rows:
            if any(r[4]) and (k := key(r)) is not None:
                out[k] = [s + v for s, v in zip(out.get(k, [0.0] * 3), softmax(r[4]), strict=True)]
        return out

    smooth = lambda s, parent, w: [(x + w * p) / (sum(s) + w) for x, p in zip(s, parent, strict=True)]
    hosts, suffixes, said = sums(lambda r: (r[2], r[3] or "")), sums(lambda r: r[2] or ""), sums(lambda r: r[1])
    every = sums(lambda r: 0)[0]
    root = [(x + 1) / (sum(every) + 3) for x in every]
    spoken = [sum(v[k] for v in said.values()) for k in range(3)]
    expected = {}
    for r in rows:
        own = softmax(r[4]) if any(r[4]) else [0.0] * 3
        others = [max(0.0, s - o) for s, o in zip(hosts.get((r[2], r[3] or ""), [0.0] * 3), own, strict=True)] if r[3] else [0.0] * 3
        prior = smooth(others, smooth(suffixes[r[2] or ""], root, 20.0), 5.0)
        declared = [math.log((d + 1) / (s + len(said) + 1)) for d, s in zip(said[r[1]], spoken, strict=True)] if r[1] else [0.0] * 3
        expected[r[0]] = softmax([a + b + math.log(c) for a, b, c in zip(r[4], declared, prior, strict=True)])
    df = spark.createDataFrame(rows, "k int, declared string, suffix string, host string, loglik array<double>")
    got = L.fuse(df, langs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["posterior"] == pytest.approx(expected[r["k"]], abs=1e-9)
        assert r["lang"] == langs[expected[r["k"]].index(max(expected[r["k"]]))]


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError, match="labels"):
        L.text_model(spark.createDataFrame([(f"l{k}", "text") for k in range(4)], "lang string, text string"))


def test_documents_by_their_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    found = L.identify(docs.filter(~held_out), None, docs.filter(held_out)).join(docs.select("doc_id", F.col("lang").alias("label")), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("label")).cast("double"))).first()[0] > 0.97


def test_hosts_and_markup_decide_without_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["lang"]: r["text"] for r in docs.filter("length(text) > 200").collect()}
    a, b = sorted(texts)[:2]
    pages = [(k, "http://one.example/x", page(a, texts[a])) for k in range(9)] + [(20 + k, "http://two.test/x", page(b, texts[b])) for k in range(9)]
    pages += [(100, "http://one.example/y", page(None, "")), (101, "http://two.test/y", page(None, "12")), (102, "http://new.test/", None), (103, None, page(a, "")), (104, "not an address", "")]
    rows = {r["page_id"]: r for r in L.identify(docs, spark.createDataFrame(pages, "page_id long, url string, html string"), None).collect()}
    assert len(rows) == len(pages)
    assert (rows[100]["lang"], rows[101]["lang"], rows[102]["lang"], rows[103]["lang"]) == (a, b, b, a)
    assert rows[100]["text_lang"] is None
    assert rows[104]["host"] is None


@pytest.mark.parametrize(("url", "host", "suffix"), [("http://A.Example.COM:80/x", "a.example.com", "com"), ("//b.de", "b.de", "de"), ("https://u:p@c.fr/?q", "c.fr", "fr"), ("x/y", None, None), ("http://local/", "local", None), (None, None, None)])
def test_addresses(spark, url, host, suffix):
    row = spark.createDataFrame([(url,)], "u string").select(L.host_of(F.col("u")).alias("h"), L.suffix_of(L.host_of(F.col("u"))).alias("s")).first()
    assert (row["h"], row["s"]) == (host, suffix)


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = L.identify(docs, None, docs)
    assert got.count() == docs.count()
    assert got.filter("lang IS NULL OR confidence IS NULL").count() == 0
    nothing = L.identify(empty(spark), None, empty(spark))
    assert nothing.count() == 0
    unlabelled = L.identify(empty(spark), None, docs)
    assert {r["lang"] for r in unlabelled.collect()} == {"und"}


def test_label_of_a_row_is_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (L.identify(docs, None, d).orderBy("doc_id").select("doc_id", "lang").collect() for d in (docs, docs.withColumn("lang", F.lit("xx"))))
    assert one == two
