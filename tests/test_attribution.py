"""Language attribution by a model that each worker loads once."""

from __future__ import annotations

import os

import pytest

from quillon.operators import language

TEXT = "Der Hund ist da. the cat and the dog;  et la fin,\n zzz! THE der"


def words():
    return language.CommonWords({"de": ("der", "ist"), "EN ": ("the", "and"), "fr": ("la", "et")})


class Wrong:
    def __init__(self, told):
        self.told = told

    def attribute(self, units):
        return [self.told for _ in units][: None if self.told != "short" else -1]


class Counted:
    """Confidence is the number of models that this process has made, over ten."""

    made = 0

    def __init__(self):
        Counted.made += 1

    def attribute(self, units):
        return [(f"p{os.getpid()}", type(self).made / 10) for _ in units]


def counted():
    from tests import test_attribution

    return test_attribution.Counted()


def units(spark, texts):
    return language.text_units(spark.createDataFrame(list(enumerate(texts)), "document_id long, text string"))


def test_spans_of_units_whose_language_is_told(spark):
    got = language.attributed(units(spark, [TEXT, None, "", "...", "zzz"]), words).orderBy("start_char").collect()
    assert [(r["document_id"], TEXT[r["start_char"] : r["end_char"]], r["language"], r["confidence"]) for r in got] == [
        (0, "Der Hund ist da.", "de", 1.0), (0, "the cat and the dog;", "en", 1.0), (0, "et la fin,", "fr", 1.0),
    ]


def test_spans_feed_the_projection(spark):
    texts = ["Der Hund ist da.", "the cat and the dog"]
    segments = spark.createDataFrame([(7, i, f"s{i}", t) for i, t in enumerate(texts)], "document_id long, segment_index int, segment_id string, text string")
    whole = spark.createDataFrame([(7, "\n".join(texts))], "document_id long, text string")
    projected = language.project_spans(segments, language.attributed(language.text_units(whole), words))
    assert sorted(map(tuple, projected.collect())) == [(7, "s0", 0, 16, "de", 1.0), (7, "s1", 0, 19, "en", 1.0)]
    assert {r["segment_id"]: r["language"] for r in language.segment_languages(projected).collect()} == {"s0": "de", "s1": "en"}


def test_one_model_for_many_batches(spark):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = language.attributed(units(spark, ["a."] * 200), counted).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(got) == 200 and {r["confidence"] for r in got} == {0.1}


@pytest.mark.parametrize("told", [("", 0.5), ("en", 1.5), ("en", float("nan")), "short"])
def test_wrong_models_are_errors(spark, told):
    with pytest.raises(Exception, match="without a code|languages of"):
        language.attributed(units(spark, ["a. b."]), Wrong, told).collect()


def test_ambiguous_units_and_many_rows(spark):
    assert words().attribute(["the der", "", "the der the"]) == [None, None, ("EN ", pytest.approx(2 / 3))]
    assert language.attributed(units(spark, []).limit(0), words).count() == 0


def test_texts_do_not_pass_the_window_of_places(spark):
    """Only lengths do, where no unit is asked for."""
    rows = spark.createDataFrame([(1, " ab. c\n　d ")], "document_id long, text string")
    spans = language.text_units(rows).select("document_id", "start_char", "end_char")
    assert "raw" not in spans._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
    assert sorted(tuple(r) for r in spans.collect()) == [(1, 1, 4), (1, 5, 6), (1, 8, 9)]
