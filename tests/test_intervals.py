"""Interval joins of mixed length against a plain comparison of all pairs, and how many rows an interval becomes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import intervals


def _made(seed: int, n: int, shortest: float, longest: float, grid: float | None = None):
    """Lengths from ``shortest`` to ``longest`` spread over all orders of magnitude; on a grid many bounds touch."""
    random.seed(seed)
    rows = []
    for i in range(n):
        start, length = random.uniform(-5e4, 4e5), shortest * (longest / shortest) ** random.random()
        if grid:
            start, length = round(start / grid) * grid, max(0, round(length / grid)) * grid
        rows.append((random.choice("xy"), i, start, start + length))
    return rows


def _brute(a, b, strict):
    meets = (lambda s, e, t, f: min(e, f) > max(s, t)) if strict else (lambda s, e, t, f: min(e, f) >= max(s, t))
    return sorted((i, j) for d, i, s, e in a for g, j, t, f in b if d == g and meets(s, e, t, f))


@pytest.mark.parametrize("grid", [None, 24.0, 60.0])
def test_lengths_from_a_tenth_of_a_second_to_100_hours(spark, grid):
    a, b = _made(1, 400, 0.1, 360_000.0, grid), _made(2, 300, 0.1, 360_000.0, grid)
    left = spark.createDataFrame(a, "document_id string, i int, s double, e double")
    right = spark.createDataFrame(b, "document_id string, j int, ts double, te double")
    got = intervals.overlap_join(left, right, ["document_id"], ("s", "e"), ("ts", "te"))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == _brute(a, b, True)
    assert got.columns == ["document_id", "i", "s", "e", "j", "ts", "te"]
    closed = intervals.bucket_join(left, right, ["document_id"], ("s", "e"), ("ts", "te")).filter(F.least("e", "te") >= F.greatest("s", "ts"))
    assert sorted((r["i"], r["j"]) for r in closed.collect()) == _brute(a, b, False)


def test_whole_numbers_and_one_side_much_longer(spark):
    a = [("x", i, 7 * i, 7 * i + 6) for i in range(500)]
    b = [("x", 0, 0, 100_000_000), ("x", 1, 100, 101), ("x", 2, 3_000, 90_000)]
    left = spark.createDataFrame(a, "document_id string, i int, s long, e long")
    right = spark.createDataFrame(b, "document_id string, j int, ts long, te long")
    got = intervals.overlap_join(left, right, ["document_id"], ("s", "e"), ("ts", "te"), 2000.0).collect()
    assert sorted((r["i"], r["j"]) for r in got) == _brute(a, b, True)


def test_a_long_turn_is_at_most_four_rows(spark):
    """Ten and 100 hours among words of a second: two rows as the longer one, one for each longer level that the other side has."""
    words = spark.createDataFrame([("x", float(i), i + 0.9) for i in range(1000)], "document_id string, s double, e double")
    turns = spark.createDataFrame([("x", 5.0, 36_005.0), ("x", 0.0, 360_000.0), ("x", 2.0, 9.0)], "document_id string, ts double, te double")
    rows = intervals.placed(turns, ("ts", "te"), words, ("s", "e"), 60.0, 0, False)
    assert max(r["count"] for r in rows.groupBy("ts", "te").count().collect()) <= 4
    asked = intervals.placed(words, ("s", "e"), turns, ("ts", "te"), 60.0, 1, True)
    assert {r["count"] for r in asked.groupBy("s").count().collect()} == {3}  # turns have three levels, no word is longer than a turn
    both = spark.createDataFrame(_made(3, 500, 0.1, 360_000.0), "document_id string, i int, s double, e double")
    most = intervals.placed(both, ("s", "e"), both, ("s", "e"), 60.0, 1, True).groupBy("i").agg(F.count("*").alias("n"), F.max(F.col("e") - F.col("s")).alias("long"))
    assert max(r["n"] for r in most.filter("long >= 3600").collect()) <= 5 and most.agg(F.max("n")).first()[0] <= 8


def test_null_empty_and_backward_intervals(spark):
    schema = "document_id string, s double, e double"
    left = spark.createDataFrame([("x", None, 5.0), ("x", 1.0, None), ("x", 4.0, 4.0), ("x", 9.0, 3.0), (None, 0.0, 9.0), ("x", 0.0, 2.0), ("x", 0.0, 2.0)], schema)
    right = spark.createDataFrame([("x", 0.0, 10.0)], "document_id string, ts double, te double")
    got = intervals.overlap_join(left, right, ["document_id"], ("s", "e"), ("ts", "te")).collect()
    assert [(r["s"], r["e"]) for r in got] == [(0.0, 2.0), (0.0, 2.0)]
    assert intervals.overlap_join(left, right.limit(0), ["document_id"], ("s", "e"), ("ts", "te")).count() == 0
    assert intervals.overlap_join(left.limit(0), right, ["document_id"], ("s", "e"), ("ts", "te")).count() == 0
