from __future__ import annotations

import os

import pytest
import tiktoken

from quillon.llm import token_lengths as t

from .helpers import awkward, empty

if not os.path.exists(t.RANKS_PATH):
    pytest.skip("no vocabulary here", allow_module_level=True)
ENCODING = tiktoken.Encoding("test", pat_str=t.PATTERN, mergeable_ranks=t.load_ranks(), special_tokens={})


def brute(lengths, limit):
    over = [n for n in lengths if n > limit]
    kept = sum(min(n, limit) for n in lengths)
    return len(over), sum(over), len(lengths) - len(over), kept, sum(lengths) - kept


@pytest.mark.parametrize("group", [1, 3, 1024])
def test_limits_equal_brute_force(spark, group):
    docs = awkward(spark)
    lengths = [len(ENCODING.encode_ordinary(r["text"] or "")) for r in docs.collect()]
    counted = t.lengths(docs)
    assert sorted(r["n_tokens"] for r in counted.collect()) == sorted(lengths)
    answers = t.limits(t.histogram(counted), group)
    rows = {r["n_tokens"]: r for r in answers.collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        assert (r["docs_over"], r["tokens_over"], r["docs_within"], r["kept_tokens"], r["cut_tokens"]) == brute(lengths, limit)
        assert r["n_docs"] == lengths.count(limit)
        assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths))
    wanted = spark.createDataFrame([(0,), (2,), (2,), (100,), (10**6,)], "context_limit long")
    for r in t.at_limits(answers, wanted, group=group).collect():
        over, _, _, kept, cut = brute(lengths, r["context_limit"])
        assert (r["docs_over"], r["kept_tokens"], r["cut_tokens"]) == (over, kept, cut)
    ordered = sorted(lengths)
    for r in t.quantiles(answers, [0.1, 0.5, 0.9, 1.0]).collect():
        assert r["n_tokens"] == next(n for n in ordered if sum(x <= n for x in ordered) / len(ordered) >= r["share"])


def test_no_lengths_and_null_limits(spark):
    none = t.limits(t.histogram(spark.createDataFrame([], "n_tokens long")))
    wanted = spark.createDataFrame([(None,), (7,)], "context_limit long")
    assert [tuple(r) for r in t.at_limits(none, wanted).collect()] == [(7, 0, 0, 0)]


def test_empty(spark):
    assert t.limits(t.histogram(t.lengths(empty(spark)))).count() == 0
    assert t.histogram(spark.createDataFrame([(None,), (3,)], "n_tokens long")).collect() == [(3, 1)]
