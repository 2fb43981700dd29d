"""Fixed windows over recordings, and window results rebased onto one timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WINDOW_SECONDS = 600
#: A result may pass its window's end by this much; ends this near to it are it (seconds, fixed values).
TOLERANCE, BOUNDARY = 0.05, 1e-9


def window_plan(recordings: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``recordings`` (document_id, frames, sample_rate_hz): contiguous windows window_index, start_frame, end_frame, start/end_seconds, window_id."""
    step = F.col("sample_rate_hz") * seconds
    rows = recordings.filter("frames > 0").withColumn("start_frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, step.cast("long"))))
    rows = rows.withColumn("window_index", F.floor(F.col("start_frame") / step).cast("int")).withColumn("end_frame", F.least(F.col("start_frame") + step, F.col("frames")))
    return rows.select(
        "document_id", "window_index", F.format_string("audio-%06d", "window_index").alias("window_id"), "start_frame", "end_frame", "sample_rate_hz",
        (F.col("start_frame") / F.col("sample_rate_hz")).alias("start_seconds"), (F.col("end_frame") / F.col("sample_rate_hz")).alias("end_seconds"),
    )


def rebased(start: Column, end: Column, window_start: Column, window_end: Column) -> tuple[Column, Column]:
    """A result's start and end on the source timeline; an end at or over the window's end is the window's end."""
    length = window_end - window_start
    snapped = (end > length) | (F.abs(end - length) <= BOUNDARY)
    return F.least(window_end, window_start + start), F.when(snapped, window_end).otherwise(window_start + end)


def assemble(windows: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` (document_id, window_index, local_index, start_seconds, end_seconds, text, language) on one timeline, numbered
    through as segment_index; ends over the tolerance fail."""
    frame = windows.select("document_id", "window_index", F.col("start_seconds").alias("ws"), F.col("end_seconds").alias("we"))
    start, end = rebased(F.col("start_seconds"), F.col("end_seconds"), F.col("ws"), F.col("we"))
    late = F.col("end_seconds") > F.col("we") - F.col("ws") + TOLERANCE
    met = results.join(frame, ["document_id", "window_index"])
    number = F.row_number().over(W.partitionBy("document_id").orderBy("window_index", "local_index")) - 1
    checked = F.when(late, F.raise_error(F.lit("timestamps outside their window"))).otherwise(end)
    return met.withColumn("_s", start).withColumn("_e", checked).withColumn("segment_index", number).select(
        "document_id", "window_index", "segment_index", F.format_string("segment-%06d", "segment_index").alias("segment_id"), F.col("_s").alias("start_seconds"), F.col("_e").alias("end_seconds"), "text", "language"
    )


def summary(results: DataFrame) -> DataFrame:
    """Per document of window results (language, language_probability): the language if all agree, with the least probability."""
    per = results.groupBy("document_id").agg(F.count_distinct("language").alias("n"), F.min("language").alias("l"), F.min("language_probability").alias("p"))
    one = F.col("n") == 1
    return per.select("document_id", F.when(one, F.col("l")).alias("language"), F.when(one, F.col("p")).alias("language_probability"))


def window_violations(windows: DataFrame) -> DataFrame:
    """Windows that do not start at 0, follow the one before, or keep the rate: document_id, window_index, problem."""
    order = W.partitionBy("document_id").orderBy("window_index")
    index = F.row_number().over(order) - 1
    rows = windows.withColumns({"_n": index, "_end": F.lag("end_frame").over(order), "_rate": F.lag("sample_rate_hz").over(order)})
    problem = (
        F.when(F.col("window_index") != F.col("_n"), "index").when(F.col("_end").isNull() & (F.col("start_frame") != 0), "origin")
        .when(F.col("_end") != F.col("start_frame"), "gap").when(F.col("_rate") != F.col("sample_rate_hz"), "rate")
    )
    return rows.withColumn("problem", problem).filter("problem IS NOT NULL").select("document_id", "window_index", "problem")


def complete_prefix(stored: DataFrame) -> DataFrame:
    """Per document: how many stored windows form an unbroken run from 0 (what a restart may skip)."""
    order = W.partitionBy("document_id").orderBy("window_index")
    rows = stored.select("document_id", "window_index").distinct().withColumn("_n", F.row_number().over(order) - 1)
    return rows.groupBy("document_id").agg(F.sum((F.col("window_index") == F.col("_n")).cast("long")).alias("complete"))
