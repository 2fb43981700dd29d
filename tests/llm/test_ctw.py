from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest

from quillon.llm import ctw

from .helpers import awkward, empty

DEPTH = ctw.DEPTH


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


class Brute:
    """The same tree with dictionaries: counts of (context, bits of the byte so far)."""

    def __init__(self, texts):
        self.counts = {}
        self.memo = {}
        for t in texts:
            for context, byte in self.bytes_of(t):
                for d in range(DEPTH + 1):
                    for j in range(8):
                        node = (context[DEPTH - d :], byte >> (8 - j) | 1 << j)
                        self.counts.setdefault(node, [0, 0])[byte >> (7 - j) & 1] += 1

    @staticmethod
    def bytes_of(text):
        raw = b"\n" * DEPTH + " ".join(words_of(text)).encode() + b"\n"
        return [(raw[k - DEPTH : k], raw[k]) for k in range(DEPTH, len(raw))]

    def own(self, node):
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node):
        if node not in self.memo:
            context, bits = node
            own = self.own(node)
            if len(context) == DEPTH:
                self.memo[node] = own, 1.0
            else:
                below = sum(self.weighted((bytes([c]) + context, bits))[0] for c in range(256) if (bytes([c]) + context, bits) in self.counts)
                top = max(own, below)
                both = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below - top))
                self.memo[node] = both, math.exp(math.log(0.5) + own - both)
        return self.memo[node]

    def chance(self, context, bits, bit, d=0):
        node = (context[DEPTH - d :], bits)
        if node not in self.counts:
            return 0.5
        counts = self.counts[node]
        here = (counts[bit] + 0.5) / (sum(counts) + 1)
        share = self.weighted(node)[1]
        return share * here + (1 - share) * self.chance(context, bits, bit, d + 1) if d < DEPTH else here

    def score(self, text):
        total = 0.0
        for context, byte in self.bytes_of(text):
            for j in range(8):
                total += math.log10(self.chance(context, byte >> (8 - j) | 1 << j, byte >> (7 - j) & 1))
        return total


def check(docs, **options):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    training = [t for i, t in rows if not held_out(i)]
    model, counts = Brute(training), Counter()
    for t in training:
        counts.update([*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t in rows:
        own = [*words_of(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        expected.append((i, held_out(i), len(own), sum(counts[w] > 0 for w in own), n, base, model.score(t)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in ctw.score(docs, depth=DEPTH, **options).collect()]
    key = lambda r: (repr(r[:5]), round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_equals_brute_force(spark):
    check(awkward(spark, ["the cat sat", "the cat sat", "The  cat", "", None, " \t", "é ßx", "x" * 40, "a cat on the mat " * 4, "on the mat"]))


def test_many_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 60)
    monkeypatch.setattr(ctw, "PART_BYTES", 30)
    docs = spark.createDataFrame([(k, f"cat {k % 5} sat on mat {k % 3}") for k in range(40)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ctw, "GROUP_BYTES", 300)  # so that buckets have several salted groups
    check(docs, buckets=5)


@pytest.mark.parametrize("depth", [3, 5])
def test_other_depths(spark, monkeypatch, depth):
    monkeypatch.setitem(globals(), "DEPTH", depth)
    check(spark.createDataFrame([(k, f"cat {k % 5} sat on a mat {k % 3}") for k in range(20)], "doc_id long, text string"))


def test_no_training_rows_and_no_rows(spark):
    ids = [k for k in range(50) if held_out(k)][:2]
    docs = spark.createDataFrame([(k, "ab") for k in ids], "doc_id long, text string")
    for r in ctw.score(docs).collect():
        assert (r["n_known"], r["train_tokens"]) == (0, 0)
        assert r["score"] == pytest.approx(3 * 8 * math.log10(0.5), rel=1e-9)
        assert r["bits_per_byte"] == pytest.approx(8, rel=1e-9)
    assert ctw.score(empty(spark)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_texts_beat_the_base(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    found = ctw.score(docs).filter("held_out").agg({"score": "sum", "base_score": "sum", "bits_per_byte": "avg"}).first()
    assert found["sum(score)"] > found["sum(base_score)"]
    assert found["avg(bits_per_byte)"] < 2.5


def test_lists_come_back_whole():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    for n in (0, 1, 5000):
        keys = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64) >> np.uint64(rng.integers(0, 40)))
        assert ctw.unpack_grams(ctw.pack_grams(keys)).tolist() == keys.tolist()
        assert ctw.unpack_fixed(ctw.pack_fixed(keys)).tolist() == keys.tolist()
        logs = -rng.exponential(1.0, n) ** 4
        assert abs(ctw.from_fixed(ctw.unpack_fixed(ctw.pack_fixed(ctw.to_fixed(logs)))) - logs).max(initial=0) <= 3e-11
        words = pa.array([str(k).encode() * (k % 3) for k in keys.tolist()], pa.large_binary())
        assert ctw.unpack_words(ctw.pack_words(words)).equals(words)
    row, at, distinct = ctw.words_of(b"a bb a\n\nbb \xc3\xa9\n")
    assert [(r, distinct[k].as_py()) for r, k in zip(row.tolist(), at.tolist(), strict=True)] == [(0, b"a "), (0, b"bb "), (0, b"a "), (2, b"bb "), (2, b"\xc3\xa9 ")]
