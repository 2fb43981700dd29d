"""Invariants of evidence, each a query that returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Slack of word times, and of times against their document (seconds, fixed values).
WORD_SLACK, TIME_SLACK = 0.05, 1e-6


def segment_violations(segments: DataFrame) -> DataFrame:
    """(document_id, segment_id, problem): times (negative or backwards), order (starts before the one before), duplicate, text."""
    order = W.partitionBy("document_id").orderBy("segment_index")
    rows = segments.withColumns({"_before": F.lag("start_seconds").over(order), "_copies": F.count(F.lit(1)).over(W.partitionBy("document_id", "segment_id"))})
    times = F.col("start_seconds").isNull() | F.col("end_seconds").isNull() | (F.col("start_seconds") < 0) | (F.col("end_seconds") < F.col("start_seconds"))
    checks = F.array(
        F.when(times, F.lit("times")), F.when(F.col("start_seconds") < F.col("_before"), F.lit("order")), F.when(F.col("_copies") > 1, F.lit("duplicate")),
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.lit("text")),
    )
    return rows.select("document_id", "segment_id", F.explode(F.array_compact(checks)).alias("problem"))


def document_violations(segments: DataFrame, turns: DataFrame, durations: DataFrame) -> DataFrame:
    """(document_id, problem): index (not 0, 1, ...), speaker (of a segment but of no turn), duration (a turn ends after it)."""
    index = segments.groupBy("document_id").agg(F.min("segment_index").alias("lo"), F.max("segment_index").alias("hi"), F.count_distinct("segment_index").alias("n"))
    index = index.filter("lo <> 0 OR hi + 1 <> n").select("document_id", F.lit("index").alias("problem"))
    unknown = segments.filter("speaker_ref IS NOT NULL").select("document_id", "speaker_ref").join(turns.select("document_id", "speaker_ref"), ["document_id", "speaker_ref"], "left_anti")
    late = turns.join(durations, "document_id").filter(F.col("end_seconds") > F.col("duration_seconds") + TIME_SLACK)
    rows = index.unionByName(unknown.select("document_id", F.lit("speaker").alias("problem"))).unionByName(late.select("document_id", F.lit("duration").alias("problem")))
    return rows.distinct()


def alignment_violations(words: DataFrame, segments: DataFrame) -> DataFrame:
    """(document_id, segment_id, word_index, problem): a word that starts before a word before it ends, or outside its segment."""
    order = W.partitionBy("document_id", "segment_id").orderBy("word_index").rowsBetween(W.unboundedPreceding, -1)
    rows = words.withColumn("_end", F.max("end_seconds").over(order))
    own = segments.select("document_id", "segment_id", F.col("start_seconds").alias("_s"), F.col("end_seconds").alias("_e"))
    met = rows.join(own, ["document_id", "segment_id"])
    checks = F.array(
        F.when(F.col("start_seconds") < F.col("_end") - WORD_SLACK, F.lit("backwards")),
        F.when((F.col("start_seconds") < F.col("_s") - WORD_SLACK) | (F.col("end_seconds") > F.col("_e") + WORD_SLACK), F.lit("outside")),
    )
    return met.select("document_id", "segment_id", "word_index", F.explode(F.array_compact(checks)).alias("problem"))


def speaker_violations(words: DataFrame, segments: DataFrame) -> DataFrame:
    """(document_id, segment_id) of segments with a speaker and words that do not all have that speaker."""
    own = segments.filter("speaker_ref IS NOT NULL").select("document_id", "segment_id", F.col("speaker_ref").alias("_own"))
    other = ~F.col("speaker_ref").eqNullSafe(F.col("_own"))
    return words.join(own, ["document_id", "segment_id"]).filter(other).select("document_id", "segment_id").distinct()


def language_violations(documents: DataFrame) -> DataFrame:
    """(document_id, problem) of language summaries (detected_language, language_probability, detected_languages): blank, probability
    (not 0 to 1), mixed (one language for several), other (not the one that was found), alone (a probability without a language)."""
    one, chance, found = F.col("detected_language"), F.col("language_probability"), F.coalesce("detected_languages", F.array().cast("array<string>"))
    checks = F.array(
        F.when(F.trim(one) == "", F.lit("blank")), F.when(F.isnan(chance) | ~chance.between(0, 1), F.lit("probability")), F.when((F.size(found) > 1) & one.isNotNull(), F.lit("mixed")),
        F.when((F.size(found) > 0) & (one != F.get(found, F.lit(0))), F.lit("other")), F.when(one.isNull() & chance.isNotNull(), F.lit("alone")),
    )
    return documents.select("document_id", F.explode(F.array_compact(checks)).alias("problem"))


def span_violations(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """(document_id, segment_id, problem) of language spans: beyond (past the text), overlap, language (the segment's own language is
    not the only one of its spans)."""
    order = W.partitionBy("document_id", "segment_id").orderBy("start_char", "end_char")
    own = segments.select("document_id", "segment_id", F.length("text").alias("_n"), F.col("language").alias("_own"))
    met = spans.withColumn("_before", F.lag("end_char").over(order)).join(own, ["document_id", "segment_id"])
    checks = F.array(
        F.when(F.col("end_char") > F.col("_n"), F.lit("beyond")), F.when(F.col("start_char") < F.col("_before"), F.lit("overlap")), F.when(F.col("_own") != F.col("language"), F.lit("language")),
    )
    return met.select("document_id", "segment_id", F.explode(F.array_compact(checks)).alias("problem")).distinct()
