"""Doubling against a brute-force version: random texts over few words, awkward rows, and the given documents."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillon.llm import substring_dedup as sd
from quillon.llm.common import WORD_PATTERN

from .helpers import awkward, empty


def brute(rows, window=20):
    """(id, n_words, n_removed, kept, spans) for (id, text); rows of one id and text are one document."""
    docs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    seen, answers = {}, {}
    for none, key, text in docs:
        words = re.findall(WORD_PATTERN, text)
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if tuple(words[s : s + window]) in seen:
                gone[s : s + window] = [True] * window
            else:
                seen[tuple(words[s : s + window])] = 1
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        answers[none, key, text] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g), spans)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    return sorted(((r[0] is None, r[0] or 0), *answers[key(r)]) for r in rows)


def found(df, id_col="doc_id"):
    return sorted(((r[id_col] is None, r[id_col] or 0), r.n_words, r.n_removed, r.kept, [tuple(s) for s in r.spans]) for r in df.collect())


def random_rows(seed, n=60, words=3):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(r.randrange(5, 60))] for _ in range(6)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(r.randrange(0, 6)):
            parts += r.choice(passages) if r.random() < 0.5 else [r.choice("xyz"[:words]) for _ in range(r.randrange(0, 30))]
            if parts and r.random() < 0.3:
                parts[r.randrange(len(parts))] = "edit%d" % r.randrange(1000)
        rows.append((k, " ".join(parts)))
    return rows + [(n, "lo " * 90), (n + 1, "la la lo " * 30), (n + 2, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize(("seed", "window", "start"), [(1, 20, 5), (2, 8, 2), (3, 20, 10), (4, 4, 1)])
def test_equals_brute_force(spark, seed, window, start):
    rows = random_rows(seed)
    df = sd.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=window, start=start)
    assert found(df) == brute(rows, window)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert found(sd.dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(sd.dedup(empty(spark))) == []
    unlike = [(k, " ".join(f"{k}-{j}" for j in range(50))) for k in range(5)]
    assert found(sd.dedup(spark.createDataFrame(unlike, "doc_id long, text string"))) == brute(unlike)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(sd.dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_words_of_any_length_are_hashed_alike(monkeypatch):
    texts = [b"aa bb cc", b" bb  aa\n" + b"x" * 300 + b" aa", b"x" * 300]
    plain = sd._Block(texts, 5, 20)
    monkeypatch.setattr(sd, "_BYTES", 5)
    monkeypatch.setattr(sd, "_LONG_WORD", 100)
    monkeypatch.setattr(sd, "_powers", [])
    small = sd._Block(texts, 5, 20)
    for made in (plain, small):
        h = made.hashes
        assert len(h) == 8 and h[0] == h[4] == h[6] and h[1] == h[3] and h[5] == h[7] and len(np.unique(h)) == 4
    assert (plain.hashes[[0, 1, 2]] == small.hashes[[0, 1, 2]]).all()
