from __future__ import annotations

import hashlib

import pytest

from quillon.llm import exact_dedup

from .helpers import awkward, empty, largest_read


def brute(rows):
    """(doc_id, text) in; sorted (doc_id, keep_id, group_size, kept, sha) out."""
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        norm = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id is None, doc_id or 0, k, doc_id))
    out = []
    for norm, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[4], best[4], len(members), m[3] == best[3], sha) for m in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest_bits", [256, 4])
@pytest.mark.parametrize(("salts", "hot"), [(32, 50_000), (1, 1), (63, 6)])
def test_equals_brute_force_even_when_digests_collide(spark, digest_bits, salts, hot):
    docs = awkward(spark)
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.decide(docs, salts=salts, digest_bits=digest_bits, hot=hot).collect()]
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    plain = lambda rows: sorted([(a, b, c, e) for a, b, c, _, e in rows], key=repr)
    assert plain(got) == plain(expected)
    assert sorted(g[4] for g in got if g[3]) == sorted({e[4] for e in expected})
    assert {(g[0], g[1]) for g in got if g[3]} == {(e[0], e[1]) for e in expected if e[3]}


def test_longest_original_stays_then_smallest_id(spark):
    docs = spark.createDataFrame([(5, "ab"), (2, "a b"), (9, "a b"), (1, "ab")], "doc_id long, text string")
    assert {(r["doc_id"], r["kept"]) for r in exact_dedup.decide(docs).collect()} == {(5, False), (2, True), (9, False), (1, False)}


def test_negative_ids(spark):
    docs = spark.createDataFrame([(-(2**63), "a"), (2**63 - 1, "a"), (0, "a")], "doc_id long, text string")
    assert {r["keep_id"] for r in exact_dedup.decide(docs).collect()} == {-(2**63)}


@pytest.mark.parametrize("digest_bits", [256, 4])
def test_keep_first_keeps_whole_rows(spark, digest_bits):
    docs = awkward(spark)
    kept = exact_dedup.keep_first(docs, digest_bits=digest_bits)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in docs.collect()]
    found = [tuple(r) for r in kept.collect()]
    assert all(r in rows for r in found)
    norms = ["".join((r[1] or "").split()) for r in found]
    assert len(norms) == len(set(norms)) == len({"".join((r[1] or "").split()) for r in rows})


def test_empty_table(spark):
    assert exact_dedup.decide(empty(spark)).count() == 0
    assert exact_dedup.keep_first(empty(spark)).count() == 0


def test_hot_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('same ', 1 + id % 2) ELSE concat('t', id % 700) END AS text")
    got = exact_dedup.decide(docs).filter("kept").count()
    assert got == len({(("same" * (1 + k % 2)) if k % 3 == 0 else f"t{k % 700}") for k in range(3000)})


def test_longer_one_of_an_id_stays(spark):
    """Of rows with one id and one normalised text, the longest original is the one that stays."""
    docs = spark.createDataFrame([(1, "ab", "short"), (1, "a b", "long"), (1, "a b", "long"), (2, "a b", "other")], "doc_id long, text string, tag string")
    assert [r["tag"] for r in exact_dedup.keep_first(docs).collect()] == ["long"]
    assert sorted(r["kept"] for r in exact_dedup.decide(docs).collect()) == [False, False, False, True]


@pytest.mark.parametrize("digest_bits", [256, 4])
def test_repeated_rows_are_many_tasks(spark, digest_bits):
    """200,000 equal rows without an id: no task reads a third of them, and one stays."""
    docs = spark.range(0, 200_000, 1, 8).selectExpr("CAST(NULL AS LONG) AS doc_id", "'one two' AS text")
    docs = docs.unionByName(spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text"))
    with largest_read(spark) as read:
        got = exact_dedup.decide(docs, digest_bits=digest_bits).filter("kept").agg({"*": "count", "group_size": "max"}).first()
        assert exact_dedup.keep_first(docs, digest_bits=digest_bits).count() == 3001
    assert (got["count(1)"], got["max(group_size)"]) == (3001, 200_000)
    assert digest_bits == 4 or read() < 20_000
