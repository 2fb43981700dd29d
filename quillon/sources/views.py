"""The corpus views of this engine over plain tables.

* ``segments`` of documents: one row per line that is not blank, five seconds each;
* ``transcripts`` of conversations: one segment per turn, timed by its characters (eight a second);
* ``turns``, ``words``: speaker turns that run over into the next segment, and words of an eighth of a second;
* ``notes`` of events: a note per event with its tag, collection and time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import text as T

CHARS_PER_SECOND = 8.0
#: How long a turn runs over, in seconds.
RUN_OVER = 2.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than the cluster has cores, dealt to all of them; any larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, text, language, canonical_sha256, source_sha256."""
    return spread(read(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("document_id"), "text", F.col("lang").alias("language"), F.sha2("text", 256).alias("canonical_sha256"), F.sha2("source", 256).alias("source_sha256")
    )


def segments(spark: SparkSession, sf_dir: str, with_sha: bool = False) -> DataFrame:
    """document_id, segment_index, segment_id, text, language, speaker_ref (null), start_seconds, end_seconds; positions of dropped lines stay free."""
    docs = documents(spark, sf_dir)
    keep = ["document_id", "language", *(["canonical_sha256"] if with_sha else [])]
    lines = docs.select(*keep, F.posexplode(F.split("text", "\n")).alias("segment_index", "text")).filter(F.col("text").rlike(f"[^{T.SPACE}]"))
    start = F.col("segment_index") * 5.0
    return lines.select(
        "document_id", "segment_index", F.format_string("segment-%06d", "segment_index").alias("segment_id"), "text", "language", F.lit(None).cast("string").alias("speaker_ref"),
        start.alias("start_seconds"), (start + 5.0).alias("end_seconds"), *keep[2:],
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns from conversations: one segment per turn, the role as its speaker."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = spread(read(spark, sf_dir, "conversations")).withColumn("size", F.length("text"))
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("segment_index"), F.format_string("segment-%06d", "turn").alias("segment_id"), "text",
        F.lit(None).cast("string").alias("language"), F.col("role").alias("speaker_ref"),
        (F.col("before") / CHARS_PER_SECOND).alias("start_seconds"), ((F.col("before") + F.col("size")) / CHARS_PER_SECOND).alias("end_seconds"),
    )


def turns(transcript: DataFrame, run_over: float = RUN_OVER) -> DataFrame:
    """document_id, speaker_ref, start_seconds, end_seconds."""
    return transcript.select("document_id", "speaker_ref", "start_seconds", (F.col("end_seconds") + run_over).alias("end_seconds"))


def words(transcript: DataFrame) -> DataFrame:
    """document_id, segment_index, segment_id, word_index, word, start_seconds, end_seconds."""
    start = F.col("segment_start") + F.col("word_index") / CHARS_PER_SECOND
    return (
        transcript.select("document_id", "segment_index", "segment_id", F.col("start_seconds").alias("segment_start"), F.posexplode(T.words(F.col("text"))).alias("word_index", "word"))
        .select("document_id", "segment_index", "segment_id", "word_index", "word", start.alias("start_seconds"), (start + 1 / CHARS_PER_SECOND).alias("end_seconds"))
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, document_id, tag, collection, updated_at, body."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("note_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("tag"), F.date_format("ts", "yyyy-MM-dd").alias("collection"),
        F.col("ts").alias("updated_at"), F.concat_ws(" ", "event_type", "props").alias("body"),
    )
