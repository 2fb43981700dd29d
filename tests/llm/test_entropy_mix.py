from __future__ import annotations

import re

import pytest

from quillon.llm import entropy_mix

from .helpers import awkward, empty, largest_read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, cap=3):
    """sizes: source -> words. Shares by weight, excess reshared until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, left, out = sum(sizes.values()), set(names), {}
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > cap * sizes[s] + 1e-9}
        if not over:
            out |= {s: level * weight[s] for s in left}
            break
        out |= {s: float(cap * sizes[s]) for s in over}
        left -= over
    return out


def check(rows):
    """rows: (text, source, size, source_size, target, copies)"""
    sizes, taken, largest = {}, {}, {}
    for text, source, size, _, _, copies in rows:
        n = len(WORD.findall(text or ""))
        assert size == n
        assert 0 <= copies <= 3
        sizes[source] = sizes.get(source, 0) + n
        taken[source] = taken.get(source, 0) + n * copies
        largest[source] = max(largest.get(source, 0), n)
    targets = brute_targets(sizes)
    for _, source, _, source_size, target, _ in rows:
        assert source_size == sizes[source]
        assert target == pytest.approx(targets[source], rel=1e-9, abs=1e-9)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6, (source, taken[source], target, largest[source])


def rows_of(df):
    return [(r["text"], r["source"], r["__size"], r["__source_size"], r["__target"], r["__copies"]) for r in df.collect()]


def test_documents_meet_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = rows_of(entropy_mix.mix(docs))
    assert len(rows) == docs.count()
    check(rows)


def test_hot_source_and_ties(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 7 AS INT)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 20) END AS source")
    first, second = (sorted((r["doc_id"], r["__copies"]) for r in entropy_mix.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert first == second
    check(rows_of(entropy_mix.mix(docs)))


def test_awkward_rows(spark):
    docs = awkward(spark)
    mixed = entropy_mix.mix(docs)
    check(rows_of(mixed))
    assert set(docs.columns) <= set(mixed.columns)
    again = entropy_mix.repeated(docs)
    assert again.columns == docs.columns
    assert again.count() == sum(r["__copies"] for r in mixed.collect())


def test_no_words_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r["__target"], r["__copies"]) for r in entropy_mix.mix(docs).collect()} == {(0.0, 1)}
    assert entropy_mix.mix(empty(spark)).count() == 0
    assert entropy_mix.repeated(empty(spark)).count() == 0


def test_larger_rates_go_with_one_sign_of_size(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 50), "ab"[k % 4 == 0]) for k in range(400)], "doc_id long, text string, source string")
    by = {}
    for r in entropy_mix.mix(docs).filter("source = 'a'").collect():
        by.setdefault(r["__size"], []).append(r["__copies"])
    means = [sum(v) / len(v) for _, v in sorted(by.items())]
    assert means[0] == pytest.approx(1, abs=0.6)
    assert means[-1] <= means[0]


def test_rates_solve_the_dual(spark):
    """Multipliers against plain bisection: the capped exponential rates of a source's sizes meet its target."""
    import math

    sizes = {"a": [1, 1, 2, 5, 9, 9, 30], "b": [3] * 5 + [100, 7], "c": [1000, 10, 10, 11], None: [4, 4, 8]}
    docs = spark.createDataFrame([("w " * n, s) for s, own in sizes.items() for n in own], "text string, source string").selectExpr("monotonically_increasing_id() AS doc_id", "*")
    rows = entropy_mix._keyed(docs, "doc_id", "text", "source", 8)
    counts = rows.groupBy(*entropy_mix.SOURCE, "__size").count().withColumnRenamed("count", "n")
    wanted = entropy_mix.targets(counts.groupBy(*entropy_mix.SOURCE).agg({"n": "count"}).select(*entropy_mix.SOURCE).join(rows.groupBy(*entropy_mix.SOURCE).agg({"__size": "sum"}).withColumnRenamed("sum(__size)", "source_size"), entropy_mix.SOURCE))
    for r in entropy_mix.tilts(counts, wanted).collect():
        own = sizes[None if r["__none"] else r["__source"]]
        mean = sum(own) / len(own)
        if r["tilt"] is None:
            assert r["target"] == pytest.approx(3 * sum(own))
            continue
        taken = lambda t: sum(n * min(3.0, math.exp(min(t * n / mean, 2.0))) for n in own)
        low, high = -60.0, 60.0 * mean
        for _ in range(200):
            low, high = ((low + high) / 2, high) if taken((low + high) / 2) < r["target"] else (low, (low + high) / 2)
        assert taken(r["tilt"]) == pytest.approx(r["target"], rel=1e-6)
        assert r["tilt"] == pytest.approx(low, rel=1e-4, abs=1e-6)


def test_repeated_rows_are_many_tasks(spark):
    """200,000 equal rows without an id: every task sorts a part of them, and the mix still meets its targets."""
    docs = spark.range(0, 200_000, 1, 8).selectExpr("CAST(NULL AS LONG) AS doc_id", "'one two' AS text", "'s' AS source")
    docs = docs.unionByName(spark.range(300).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 7 AS INT)) AS text", "concat('t', id % 4) AS source"))
    with largest_read(spark) as read:
        got = entropy_mix.mix(docs).groupBy("text", "source", "__size", "__source_size", "__target", "__copies").count().collect()
    assert read() < 20_000
    assert sum(r["count"] for r in got) == 200_300
    check([tuple(r)[:6] for r in got for _ in range(r["count"])])
