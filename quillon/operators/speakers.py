"""Who speaks when: turns projected onto words and segments, presentation spans, rosters and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import text as T
from quillon.operators.intervals import overlap_join

SINGLE, OVERLAP, MIXED, NONE = "single-speaker", "overlap", "mixed-unresolved", "unattributed"


def active_refs(rows: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (document_id, start_seconds, end_seconds, identified by ``keys``) with active: the sorted speakers whose
    turns overlap them (empty if none)."""
    other = turns.select("document_id", F.col("speaker_ref").alias("_ref"), F.col("start_seconds").alias("_ts"), F.col("end_seconds").alias("_te"))
    met = overlap_join(rows.select(*keys, "start_seconds", "end_seconds"), other, ["document_id"], ("start_seconds", "end_seconds"), ("_ts", "_te"))
    found = met.groupBy(*keys).agg(F.array_sort(F.collect_set("_ref")).alias("active"))
    return rows.join(found, keys, "left").withColumn("active", F.coalesce("active", F.array().cast("array<string>")))


def project(rows: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with speaker_ref: the one speaker that overlaps them, null for none or several."""
    return active_refs(rows, turns, keys).withColumn("speaker_ref", F.when(F.size("active") == 1, F.col("active")[0])).drop("active")


def segment_refs(words: DataFrame) -> DataFrame:
    """Per segment of projected words: the speaker if all its words have the same one."""
    whole = words.groupBy("document_id", "segment_id").agg(F.count(F.lit(1)).alias("n"), F.count("speaker_ref").alias("known"), F.min("speaker_ref").alias("a"), F.max("speaker_ref").alias("b"))
    return whole.select("document_id", "segment_id", F.when((F.col("n") == F.col("known")) & (F.col("a") == F.col("b")), F.col("a")).alias("speaker_ref"))


def word_spans(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Neighbouring words of one kind and the same speakers, merged: document_id, segment_id, span_no, kind, speaker_refs,
    start_seconds, end_seconds, text. ``words`` needs word, word_index and its canonical speaker_ref (may be null).

    Several active speakers are an overlap; otherwise the canonical speaker counts; one active turn alone never
    attributes a word."""
    rows = active_refs(words, turns, ["document_id", "segment_id", "word_index"])
    given = F.col("speaker_ref").isNotNull() & (T.strip(F.col("speaker_ref")) != "")
    rows = rows.withColumns(
        {
            "kind": F.when(F.size("active") > 1, OVERLAP).when(given, SINGLE).otherwise(NONE),
            "speaker_refs": F.when(F.size("active") > 1, F.col("active")).when(given, F.array("speaker_ref")).otherwise(F.array().cast("array<string>")),
        }
    )
    order = W.partitionBy("document_id", "segment_id").orderBy("word_index")
    state = F.struct("kind", "speaker_refs")
    changed = (~state.eqNullSafe(F.lag(state).over(order))).cast("int")
    spans = rows.withColumn("changed", changed).withColumn("span_no", F.sum("changed").over(order))
    return spans.groupBy("document_id", "segment_id", "span_no").agg(
        F.first("kind").alias("kind"), F.first("speaker_refs").alias("speaker_refs"), F.min("start_seconds").alias("start_seconds"), F.max_by("end_seconds", "word_index").alias("end_seconds"),
        T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "word"))), lambda x: x["word"]), "")).alias("text"),
    )


def simultaneous(segments: DataFrame, turns: DataFrame, width: float = 60.0) -> DataFrame:
    """(document_id, segment_id) of segments in which turns of two different speakers share some time."""
    first = turns.select("document_id", F.col("speaker_ref").alias("_ra"), F.col("start_seconds").alias("_as"), F.col("end_seconds").alias("_ae"))
    second = turns.select("document_id", F.col("speaker_ref").alias("_rb"), F.col("start_seconds").alias("_bs"), F.col("end_seconds").alias("_be"))
    pairs = overlap_join(first, second, ["document_id"], ("_as", "_ae"), ("_bs", "_be"), width).filter("_ra < _rb")
    common = pairs.select("document_id", F.greatest("_as", "_bs").alias("_cs"), F.least("_ae", "_be").alias("_ce"))
    own = segments.select("document_id", "segment_id", "start_seconds", "end_seconds")
    return overlap_join(own, common, ["document_id"], ("start_seconds", "end_seconds"), ("_cs", "_ce"), width).select("document_id", "segment_id").distinct()


def segment_spans(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """One span per segment without words: kind and speaker_refs."""
    rows = active_refs(segments, turns, ["document_id", "segment_id"]).join(simultaneous(segments, turns).withColumn("both", F.lit(True)), ["document_id", "segment_id"], "left")
    given = F.col("speaker_ref").isNotNull() & (T.strip(F.col("speaker_ref")) != "")
    kind = F.when(given, SINGLE).when(F.size("active") <= 1, NONE).when(F.col("both"), OVERLAP).otherwise(MIXED)
    refs = F.when(given, F.array("speaker_ref")).when(F.size("active") <= 1, F.array().cast("array<string>")).otherwise(F.col("active"))
    return rows.select("document_id", "segment_id", kind.alias("kind"), refs.alias("speaker_refs"), "start_seconds", "end_seconds", T.strip(F.col("text")).alias("text"))


def roster(segments: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Speakers of each document with their label and display name; ``labels``: document_id, canonical_sha256?, speaker_ref, label. Where both sides tell the generation, a
    speaker has the label of their own, and only without one a label of another (see :func:`label_views` for which are current): a speaker is one row."""
    made = ["label", "display_name"]
    if labels is None:
        refs = segments.filter("speaker_ref IS NOT NULL").select("document_id", "speaker_ref").distinct()
        return refs.withColumn("label", F.lit(None).cast("string")).withColumn("display_name", F.col("speaker_ref"))
    keys = label_keys(segments, labels)
    refs = segments.filter("speaker_ref IS NOT NULL").select(*keys).distinct()
    if len(keys) == 2:
        met = refs.join(labels.select(*keys, "label"), keys, "left")
        return met.withColumn("display_name", T.display_name(F.col("label"), F.col("speaker_ref")))
    theirs = labels.select("document_id", "speaker_ref", F.col("canonical_sha256").alias("_g"), "label")
    own = F.col("canonical_sha256").eqNullSafe(F.col("_g"))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.when(own, 0).otherwise(1), "_g", "label"))
    met = refs.join(theirs, ["document_id", "speaker_ref"], "left").withColumn("_n", first).filter("_n = 1")
    return met.withColumn("display_name", T.display_name(F.col("label"), F.col("speaker_ref"))).select("document_id", "speaker_ref", *made)


def label_keys(rows: DataFrame, labels: DataFrame | None) -> list[str]:
    """What a label belongs to: a speaker of a document, in one generation where both sides tell it."""
    both = "canonical_sha256" in rows.columns and labels is not None and "canonical_sha256" in labels.columns
    return ["document_id", *(["canonical_sha256"] if both else []), "speaker_ref"]


def label_views(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Labels of all generations; current: the label's generation is the document's."""
    now = documents.select("document_id", F.col("canonical_sha256").alias("_c"))
    return labels.join(now, "document_id", "left").withColumn("current", F.coalesce(F.col("canonical_sha256") == F.col("_c"), F.lit(False))).drop("_c")


def numbered(turns: DataFrame, label_col: str = "label") -> DataFrame:
    """``turns`` with speaker_ref ``speaker-NN``, numbered by first appearance in (start, end, label) order in each document."""
    first = turns.groupBy("document_id", label_col).agg(F.min(F.struct("start_seconds", "end_seconds", label_col)).alias("f"))
    number = F.row_number().over(W.partitionBy("document_id").orderBy("f"))
    return turns.join(first.select("document_id", label_col, F.format_string("speaker-%02d", number).alias("speaker_ref")), ["document_id", label_col])


def refs_of(segments_ref: Column, words_refs: Column) -> Column:
    """Sorted distinct speakers of a segment and its words, blanks left out."""
    every = F.concat(F.array(segments_ref), words_refs)
    return F.array_sort(F.array_distinct(F.filter(every, lambda r: r.isNotNull() & (T.strip(r) != ""))))
