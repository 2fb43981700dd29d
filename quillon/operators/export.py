"""Subtitles and plain text of transcripts, one file's content per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import text as T
from quillon.functions import time as D


def cues(segments: DataFrame, separator: str) -> DataFrame:
    """document_id, segment_index, segment_id, cue_number (from 1), start, end, body."""
    number = F.row_number().over(W.partitionBy("document_id").orderBy("segment_index"))
    return segments.select(
        "document_id", "segment_index", "segment_id", number.alias("cue_number"), D.cue_time(F.col("start_seconds"), separator).alias("start"),
        D.cue_time(F.col("end_seconds"), separator, end=True).alias("end"), T.speaker_text(F.col("text"), F.col("speaker_ref")).alias("body"),
    )


def _documents(blocks: DataFrame, between: str) -> DataFrame:
    rows = blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", "block"))).alias("s"))
    return rows.select("document_id", F.array_join(F.transform("s", lambda x: x["block"]), between).alias("content"))


def srt(segments: DataFrame) -> DataFrame:
    """(document_id, content): numbered cues with comma milliseconds."""
    block = F.concat_ws("\n", F.col("cue_number").cast("string"), F.concat("start", F.lit(" --> "), "end"), "body")
    return _documents(cues(segments, ",").withColumn("block", block), "\n\n").withColumn("content", F.concat("content", F.lit("\n\n")))


def vtt(segments: DataFrame) -> DataFrame:
    """(document_id, content): cues named by segment, after the header."""
    block = F.concat_ws("\n", "segment_id", F.concat("start", F.lit(" --> "), "end"), "body")
    return _documents(cues(segments, ".").withColumn("block", block), "\n\n").withColumn("content", F.concat(F.lit("WEBVTT\n\n"), "content", F.lit("\n\n")))


def txt(segments: DataFrame) -> DataFrame:
    """(document_id, content): one line per segment, speakers in front if any is known in the document; else the plain text."""
    spoken = F.max(F.col("speaker_ref").isNotNull()).over(W.partitionBy("document_id"))
    block = F.when(spoken, T.speaker_text(F.col("text"), F.col("speaker_ref"))).otherwise(F.col("text"))
    return _documents(segments.withColumn("block", block), "\n").withColumn("content", F.concat("content", F.lit("\n")))
