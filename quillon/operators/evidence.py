"""Evidence around hits: context, highlights, seek points, anchors and their review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import text as T
from quillon.operators.intervals import bucket_join, contains_point

TOLERANCE = 1e-6


def context(hits: DataFrame, segments: DataFrame, around: int) -> DataFrame:
    """Segments from ``around`` before the first to ``around`` after the last of each hit (hit_id, document_id, first_index,
    last_index); is_match marks the hit's own. Each hit asks for its own few positions, so the join is on equal keys."""
    if not 0 <= around <= 10:
        raise ValueError("around must be 0 to 10")
    wanted = hits.withColumn("segment_index", F.explode(F.sequence(F.col("first_index") - around, F.col("last_index") + around)))
    inside = F.col("segment_index").between(F.col("first_index"), F.col("last_index"))
    return wanted.join(segments, ["document_id", "segment_index"]).withColumn("is_match", inside).drop("first_index", "last_index")


def phrase_positions(tokens: Column, places: Column, asked: list[str]) -> Column:
    """Places (word numbers, parallel to ``tokens``) of all runs of tokens equal to ``asked``; runs may overlap."""
    n = len(asked)
    if not n:
        return F.array().cast("array<int>")
    run = F.array(*[F.lit(t) for t in asked])
    offsets = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(offsets, lambda o: F.slice(tokens, o, n) == run)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda o: F.slice(places, o, n)))))


def highlights(segments: DataFrame, words: DataFrame, query: str, phrase: bool = False) -> DataFrame:
    """(document_id, segment_id, highlighted, seek_seconds): sorted numbers of the words that answer the query, and where to
    start playing: the first such word, else the segment's start.

    With ``phrase`` the tokens must follow each other, repeated ones too; without, any of them counts."""
    asked = [x.casefold() for x in T._DRIVER_TOKEN.findall(query)]
    item = F.struct("word_index", F.col("start_seconds").alias("at"), T.tokens(F.col("word")).alias("t"))
    whole = words.groupBy("document_id", "segment_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    if phrase:
        places = F.flatten(F.transform("s", lambda x: F.transform(x["t"], lambda _: x["word_index"])))
        whole = whole.select("document_id", "segment_id", "s", F.flatten(F.transform("s", lambda x: x["t"])).alias("tokens"), places.alias("places"))
        found = phrase_positions(F.col("tokens"), F.col("places"), asked)
    else:
        wanted = F.array(*[F.lit(t) for t in asked]).cast("array<string>")
        found = F.transform(F.filter("s", lambda x: F.arrays_overlap(x["t"], wanted)), lambda x: x["word_index"])
    per = whole.withColumn("highlighted", found)
    seek = F.get(F.filter("s", lambda x: x["word_index"] == F.get("highlighted", F.lit(0))), F.lit(0))["at"]
    per = per.select("document_id", "segment_id", "highlighted", seek.alias("_seek"))
    return segments.join(per, ["document_id", "segment_id"], "left").select(
        "document_id", "segment_id", F.coalesce("highlighted", F.array().cast("array<int>")).alias("highlighted"), F.coalesce("_seek", "start_seconds").alias("seek_seconds")
    )


def anchor_checks(anchors: DataFrame, segments: DataFrame) -> DataFrame:
    """Per anchor (anchor_id, document_id, segment_ids, start_seconds, end_seconds): found (all segments exist), contiguous (in
    canonical order without gaps) and in_time (its range lies within its segments, give or take 1e-6)."""
    parts = anchors.select("anchor_id", "document_id", F.posexplode("segment_ids").alias("ordinal", "segment_id"))
    place = segments.select("document_id", "segment_id", "segment_index", F.col("start_seconds").alias("_s"), F.col("end_seconds").alias("_e"))
    met = parts.join(place, ["document_id", "segment_id"]).groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("segment_index").alias("lo"), F.max("segment_index").alias("hi"),
        F.count_distinct(F.col("segment_index") - F.col("ordinal")).alias("offsets"), F.min("_s").alias("s"), F.max("_e").alias("e"),
    )
    out = anchors.join(met, "anchor_id", "left")
    found = F.coalesce(F.col("n") == F.size("segment_ids"), F.lit(False))
    return out.select(
        "anchor_id", "document_id", found.alias("found"), (found & (F.col("offsets") == 1) & (F.col("hi") - F.col("lo") + 1 == F.col("n"))).alias("contiguous"),
        F.coalesce(found & (F.col("start_seconds") >= F.col("s") - TOLERANCE) & (F.col("end_seconds") <= F.col("e") + TOLERANCE), F.lit(False)).alias("in_time"),
    )


def reopened(anchors: DataFrame, documents: DataFrame, segments: DataFrame) -> DataFrame:
    """Anchors (those of :func:`anchor_checks`, with canonical_sha256 and source_sha256) as evidence that can be opened:
    status, and, where it is "open", text and seek_seconds.

    The document must exist and have the anchor's generation and source ("missing", "changed"), the segments must follow each
    other and hold the anchor's time ("broken")."""
    now = documents.select("document_id", F.col("canonical_sha256").alias("_c"), F.col("source_sha256").alias("_s"))
    checks = anchor_checks(anchors, segments).select("anchor_id", "contiguous", "in_time")
    parts = anchors.select("anchor_id", "document_id", F.posexplode("segment_ids").alias("ordinal", "segment_id")).join(segments.select("document_id", "segment_id", "text"), ["document_id", "segment_id"])
    texts = parts.groupBy("anchor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: T.strip(x["text"])), " ").alias("text"))
    met = anchors.join(now, "document_id", "left").join(checks, "anchor_id", "left").join(texts, "anchor_id", "left")
    same = (F.col("canonical_sha256") == F.col("_c")) & (F.col("source_sha256") == F.col("_s"))
    status = F.when(F.col("_c").isNull(), "missing").when(~F.coalesce(same, F.lit(False)), "changed").when(F.col("contiguous") & F.col("in_time"), "open").otherwise("broken")
    opened = status == "open"
    return met.select("anchor_id", "document_id", status.alias("status"), F.when(opened, F.col("text")).alias("text"), F.when(opened, F.col("start_seconds")).alias("seek_seconds"))


def reanchored(notes: DataFrame, requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """What comes of requests (note_id, document_id, segment_ids, canonical_sha256) to move notes to another anchor, one per note:
    outcome "moved", or why not: "unknown note", "other document", "same anchor", "no candidate", "stale" (the candidate's
    generation is not the one that was confirmed, or nothing was confirmed).

    ``notes`` has note_id, document_id, segment_ids; ``candidates`` those of :func:`candidate_anchors` with canonical_sha256."""
    own = notes.select("note_id", F.col("document_id").alias("_d"), F.col("segment_ids").alias("_ids"))
    offered = candidates.select("note_id", F.col("segment_ids").alias("_o"), F.col("canonical_sha256").alias("_oc"))
    met = requests.join(own, "note_id", "left").join(offered, "note_id", "left")
    outcome = (
        F.when(F.col("_d").isNull(), "unknown note").when(~F.col("document_id").eqNullSafe(F.col("_d")), "other document").when(F.col("segment_ids") == F.col("_ids"), "same anchor")
        .when(F.col("_o").isNull() | (F.col("_o") != F.col("segment_ids")), "no candidate").when(~F.col("canonical_sha256").eqNullSafe(F.col("_oc")) | F.col("_oc").isNull(), "stale").otherwise("moved")
    )
    return met.select(*requests.columns, outcome.alias("outcome"))


def candidate_anchors(notes: DataFrame, documents: DataFrame, segments: DataFrame) -> DataFrame:
    """For notes of an older generation of the same source: the current segments in the note's time, and the range
    clipped to them. A point takes the segments that touch it; a range those that share time with it."""
    now = documents.select("document_id", F.col("canonical_sha256").alias("_c"), F.col("source_sha256").alias("_s"))
    old = notes.join(now, "document_id").filter((F.col("canonical_sha256") != F.col("_c")) & (F.col("source_sha256") == F.col("_s")))
    old = old.select("note_id", "document_id", F.col("start_seconds").alias("ns"), F.col("end_seconds").alias("ne"))
    point = F.col("ns") == F.col("ne")
    inside = F.when(point, contains_point(F.col("start_seconds"), F.col("end_seconds"), F.col("ns"))).otherwise((F.col("end_seconds") > F.col("ns")) & (F.col("start_seconds") < F.col("ne")))
    own = segments.select("document_id", "segment_index", "segment_id", "start_seconds", "end_seconds")
    met = bucket_join(old, own, ["document_id"], ("ns", "ne"), ("start_seconds", "end_seconds")).filter(inside)
    per = met.groupBy("note_id", "document_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "segment_id"))), lambda x: x["segment_id"]).alias("segment_ids"),
        F.first("ns").alias("ns"), F.first("ne").alias("ne"), F.min_by("start_seconds", "segment_index").alias("s"), F.max_by("end_seconds", "segment_index").alias("e"),
    )
    out = per.withColumn("candidate_start", F.greatest("ns", "s")).withColumn("candidate_end", F.least("ne", "e"))
    return out.filter("candidate_end >= candidate_start").select("note_id", "document_id", "segment_ids", "candidate_start", "candidate_end")


def review(notes: DataFrame, documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Status of each note's evidence: current_verified, older_verified (a candidate exists) or unavailable."""
    now = documents.select("document_id", F.col("canonical_sha256").alias("_c"), F.col("source_sha256").alias("_s"))
    met = notes.join(now, "document_id", "left").join(candidates.select("note_id", F.lit(True).alias("_has")), "note_id", "left")
    same = (F.col("canonical_sha256") == F.col("_c")) & (F.col("source_sha256") == F.col("_s"))
    status = F.when(F.coalesce(same, F.lit(False)), "current_verified").when(F.col("_has"), "older_verified").otherwise("unavailable")
    return met.withColumn("status", status).drop("_c", "_s", "_has")


def anchor_history(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``changes`` with revision 1, 2, ... in order for each key and whether it is the current one. A listing sorts by
    descending revision, the newest first."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    last = F.count(F.lit(1)).over(W.partitionBy(key))
    return changes.withColumn("revision", n).withColumn("is_current", F.col("revision") == last)
