"""The audit against a brute-force version, on awkward rows, and with the split of terms anywhere."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from quillon.llm import divergence

from .helpers import awkward, empty


def brute(rows, ranks=200, min_docs=3):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(divergence.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = sorted(s for x, s in groups if x == lang)
        shares, whole = {}, Counter()
        for s in own:
            total = sum(counts[lang, s][t] for t in kept)
            shares[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (total + len(kept)) for t in kept}
            whole.update({t: counts[lang, s][t] for t in kept})
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        far = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(o, sum(far(shares[s][t], shares[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, far(shares[s][t], q[t])) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < ranks]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def random_rows(seed, n=120, sources=9):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghijk" for b in ("", "x", "é", "Ü")]
    return [(r.choice(["en", "de", None]), r.choice([f"s{k}" for k in range(sources)] + [None]), " ".join(r.choices(words, k=r.randrange(0, 30), weights=[1 / (k + 1) for k in range(len(words))]))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(divergence.audit(docs, ranks=7)) == brute(rows, ranks=7)


def test_the_split_changes_nothing(spark, monkeypatch):
    rows = random_rows(3)
    made = divergence.Audit(spark.createDataFrame(rows, "lang string, source string, text string"))
    wanted = [x[:2] + x[3:] for x in brute(rows) if x[2] == "pair"]
    for bounds in ((0, 0.0), (3, 0.0), (100, 1.0)):
        assert sorted(map(tuple, made.distances(light_groups=bounds[0], light_share=bounds[1]).select("lang", "source", "item", "value", "rank").collect())) == wanted


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert rows_of(divergence.audit(docs)) == brute([(r.lang, r.source, r.text) for r in docs.collect()])
    assert rows_of(divergence.audit(empty(spark))) == []
    alone = spark.createDataFrame([("en", "a", None), ("en", "b", " .")], "lang string, source string, text string")
    assert rows_of(divergence.audit(alone)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_large_counts_stay_exact(spark):
    made = spark.range(1).select(divergence.share(divergence.F.lit(10**13), divergence.F.lit(3 * 10**13), divergence.F.lit(7)).alias("p")).first().p
    assert made == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 7)


def test_counting_tasks_send_on_what_they_hold(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a"] * 4), pa.array(["b c d e", "b", "b b", "c"])], names=["l", "s", "t"])
    found = Counter()
    for out in divergence._count_batches([batch]):
        found.update({t: n for t, n in zip(out.column(2).to_pylist(), out.column(3).to_pylist(), strict=True)})
    assert found == Counter(b=4, c=2, d=1, e=1)
