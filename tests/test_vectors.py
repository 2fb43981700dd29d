"""Many vectors at once against plain sums, over widths, ties, broken vectors and block borders."""

from __future__ import annotations

import math
import random

import pytest

from quillon.operators import semantic


def _brute(rows, asked, limit, places):
    out = []
    for q, v in asked:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        scored = [(-round(sum(a * b for a, b in zip(v, w)), places) + 0.0, c) for c, w in rows if c is not None and w is not None and len(w) == len(v) and len(w) and all(x is not None and math.isfinite(x) for x in w)]
        out += [(q, c, -s + 0.0) for s, c in sorted(scored)[:limit]]
    return sorted(out)


@pytest.mark.parametrize("ids", ["long", "string"])
@pytest.mark.parametrize("block,held", [(1024, 1 << 20), (7, 40)])
def test_blocks_equal_plain_sums(spark, monkeypatch, ids, block, held):
    random.seed(4)
    key = (lambda i: i) if ids == "long" else (lambda i: f"é{i}")
    rows = [(key(i), [random.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(300)]  # many ties
    rows += [(key(900), [1.0, 2.0]), (key(901), None), (key(902), [1.0, None, 0.0, 0.0]), (key(903), [float("nan")] * 4), (None, [9.0] * 4), (key(904), [])]
    asked = [(i, [random.uniform(-1, 1) for _ in range(4)]) for i in range(20)] + [(50, [0.0] * 4), (51, [1.0, 1.0]), (52, None), (53, [None] * 4), (54, [1.0] * 9), (55, [])]
    monkeypatch.setattr(semantic, "BLOCK", block)
    monkeypatch.setattr(semantic, "HELD", held)
    left = spark.createDataFrame(rows, f"chunk_id {ids}, vector array<float>").repartition(3)
    right = spark.createDataFrame(asked, "query_id int, query_vector array<double>")
    for bytes_ in (1 << 26, 0):
        monkeypatch.setattr(semantic, "BROADCAST_BYTES", bytes_)
        got = semantic.vector_topk_many(left, right, 5, 6).collect()
        assert sorted(map(tuple, got)) == _brute(rows, asked, 5, 6)


def test_no_rows_no_queries_and_other_columns(spark):
    rows = spark.createDataFrame([(1, [1.0], "a")], "chunk_id long, vector array<double>, score string")
    asked = spark.createDataFrame([("7", [2.0], "b")], "query_id string, query_vector array<double>, chunk_id string")
    assert list(map(tuple, semantic.vector_topk_many(rows, asked, 3).collect())) == [("7", 1, 2.0)]
    assert semantic.vector_topk_many(rows.limit(0), asked, 3).count() == 0
    assert semantic.vector_topk_many(rows, asked.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="limit"):
        semantic.vector_topk_many(rows, asked, 0)
