from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import mil_quality as m
from quillon.llm import queries

from .helpers import awkward, empty


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality IS NOT NULL")
    rows = queries.op5_mil_quality(spark, sf).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    assert (good[:, None] > bad).mean() > 0.97
    assert (rows.predicted == rows.quality).mean() > 0.97
    assert (rows.predicted == (rows.score >= 0.7)).all()
    assert docs.count() == queries.op5_mil_quality(spark, sf).count()


def tiny(seed=0, width=4, gates=3):
    rng = np.random.default_rng(seed)
    shapes = {"mean": 5, "scale": 5, "w": (5, width), "b": width, "v": (width, gates), "u": (width, gates), "a": gates, "c": width, "c0": 1}
    model = m.Model(**{k: rng.normal(size=s) for k, s in shapes.items()})
    model.scale = np.abs(model.scale) + 0.5
    return model, rng.normal(size=(7, 5)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])


def test_gradients_equal_differences():
    """Every part of the gradient against the loss moved a little either way."""
    model, x, starts, y = tiny()
    grads = m.gradients(model, x, starts, y, 0.01)[1]
    for k in m.Model.PARTS:
        part = getattr(model, k)
        for at in np.ndindex(part.shape):
            was, side = part[at], []
            for step in (1e-5, -1e-5):
                part[at] = was + step
                side.append(m.gradients(model, x, starts, y, 0.01)[0])
            part[at] = was
            assert abs((side[0] - side[1]) / 2e-5 - grads[k][at]) < 1e-6, (k, at)


def test_forward_equals_brute_force():
    import math

    model, x, starts, _ = tiny(3)
    got = model.scores(x, starts)
    for k, (lo, hi) in enumerate([(0, 3), (3, 4), (4, 7)]):
        encoded, force = [], []
        for row in x[lo:hi]:
            h = [math.tanh(sum((row[i] - model.mean[i]) / model.scale[i] * model.w[i, j] for i in range(5)) + model.b[j]) for j in range(4)]
            gate = [math.tanh(sum(h[j] * model.v[j, q] for j in range(4))) / (1 + math.exp(-sum(h[j] * model.u[j, q] for j in range(4)))) for q in range(3)]
            encoded.append(h)
            force.append(math.exp(sum(g * a for g, a in zip(gate, model.a, strict=True))))
        bag = [sum(f * h[j] for f, h in zip(force, encoded, strict=True)) / sum(force) for j in range(4)]
        assert got[k] == 1 / (1 + math.exp(-(sum(b * c for b, c in zip(bag, model.c, strict=True)) + model.c0[0]))) or abs(got[k] - 1 / (1 + math.exp(-(sum(b * c for b, c in zip(bag, model.c, strict=True)) + model.c0[0])))) < 1e-12


def test_batches_do_not_change_the_fit():
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(7, 5)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    one, many = (m.fit(x, starts, y, width=4, gates=3, epochs=300, decay=0.0, most=n) for n in (100, 2))
    assert np.abs(one.scores(x, starts) - y).max() < 0.05
    assert np.allclose(one.w, many.w, atol=1e-6)


def test_documents_are_taken_whole_up_to_the_bound(spark):
    docs = spark.createDataFrame([(k, "some words here. " * 640) for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    whole, half, none = (m.train(docs, labels, most=n) for n in (10_000, 100, 5))
    assert whole is not None and half is not None and none is None


def test_attention_finds_the_one_passage():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for k in range(200):
        bag = rng.normal(size=(rng.integers(3, 12), 4))
        bag[:, 0] = 0
        if k % 2:
            bag[rng.integers(len(bag)), 0] = 4
        bags.append(bag)
        labels.append(k % 2)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
    model = m.fit(np.concatenate(bags), starts, np.array(labels, dtype=float))
    assert ((model.scores(np.concatenate(bags), starts) > 0.5) == labels).mean() > 0.95
    weight = model.forward(np.concatenate(bags), starts)[4]
    odd = [weight[s : s + len(b)][np.argmax(b[:, 0])] * len(b) for s, b, k in zip(starts, bags, labels, strict=True) if k]
    assert np.mean(odd) > 1.5


def test_passages_cover_whole_texts():
    assert m.passages(None).shape == (1, m.FEATURES)
    assert len(m.passages("w " * 640)) == 10
    a, b = m.passages("good words here. " * 500), m.passages("good words here. " * 499 + "#### $$$$ ####")
    assert not np.allclose(a[-1], b[-1])


def test_training_reads_every_passage(spark):
    """Of 400 passages the second, which even thinning to 256 leaves out, changes the fit."""
    words = [f"plain words here{k % 7}." for k in range(400 * m.PASSAGE // 3)]
    odd = [*words[:24], *["####"] * 30, *words[34:]]
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    one, two = (m.train(spark.createDataFrame([(k, " ".join(w if k % 2 else words)) for k in range(8)], "doc_id long, text string"), labels) for w in (words, odd))
    assert not np.allclose(one.mean, two.mean, rtol=0, atol=1e-9)


def test_the_same_rows_give_the_same_model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    one, two = m.train(docs, labels), m.train(docs.repartition(5), labels.repartition(3))
    assert all((getattr(one, k) == getattr(two, k)).all() for k in m.Model.PARTS)


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(m.crc_mod("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = m.train(docs, labels), m.train(docs, flipped)
    assert (one.w == two.w).all()


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (3, None), (None, 1), (8, 1), (7, 0), (77, 1)], "doc_id long, quality int")
    model = m.train(docs, labels)
    scored = m.score(docs, model)
    assert scored.columns == [*docs.columns, "__score"]
    assert scored.filter("__score IS NULL OR NOT __score BETWEEN 0 AND 1").count() == 0
    assert scored.count() == docs.count()
    assert m.keep_accepted(docs, model).columns == docs.columns
    assert m.score(empty(spark), model).count() == 0
    assert m.train(docs, labels.limit(0)) is None
    assert {r["__score"] for r in m.score(docs, None).collect()} == {0.5}
    assert m.keep_accepted(docs, None).count() == docs.count()
