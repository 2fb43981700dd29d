"""Research state over evidence: note filters, matching evidence, summaries, navigation, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import text as T


def having_all(rows: DataFrame, key: str, member: str, wanted: list) -> DataFrame:
    """Keys whose rows have every wanted member (relational division); nothing wanted: all keys."""
    if not wanted:
        return rows.select(key).distinct()
    found = rows.filter(F.col(member).isin(list(wanted))).groupBy(key).agg(F.count_distinct(member).alias("n"))
    return found.filter(F.col("n") == len(set(wanted))).select(key)


def matching_notes(notes: DataFrame, tags: list = (), collections: list = (), note_text: str | None = None, document_ids: list = ()) -> DataFrame:
    """note_id of the notes that have all tags, all collections and all words of the text, each on one note.

    ``notes``: note_id, document_id, tag, collection, body, a row per combination. A text without words matches nothing."""
    rows = notes.filter(F.col("document_id").isin(list(document_ids))) if document_ids else notes
    found = rows.select("note_id").distinct()
    if tags:
        found = found.join(having_all(rows, "note_id", "tag", tags), "note_id", "left_semi")
    if collections:
        found = found.join(having_all(rows, "note_id", "collection", collections), "note_id", "left_semi")
    if note_text is not None:
        words = T.query_tokens(note_text)
        asked = F.array(*[F.lit(w) for w in words]).cast("array<string>")
        has = F.size(F.array_except(asked, T.tokens(F.col("body")))) == 0 if words else F.lit(False)
        found = found.join(rows.filter(has).select("note_id"), "note_id", "left_semi")
    return found


def resolve(dimension: DataFrame, names: list[str], id_col: str, name_col: str) -> list | None:
    """Ids of the names (compared folded), sorted; None if any is unknown. ``names`` are the few of one query."""
    if not names:
        return []
    wanted = sorted({" ".join(n.casefold().split()) for n in names})
    found = dimension.filter(T.squeeze(F.col(name_col)).isin(wanted)).select(id_col).distinct().orderBy(id_col).limit(len(wanted) + 1).collect()
    return [r[0] for r in found] if len(found) == len(wanted) else None


def matching_evidence(matched: DataFrame, note_segments: DataFrame) -> DataFrame:
    """Distinct evidence keys of the matched notes."""
    return note_segments.join(matched, "note_id", "left_semi").drop("note_id").distinct()


def summaries(note_segments: DataFrame, tags: DataFrame, collections: DataFrame, keys: list[str]) -> DataFrame:
    """Per evidence key: sorted distinct note_ids, tags and collections. Each is gathered by itself before it meets the others."""
    spread = lambda side, col: note_segments.join(side, "note_id").groupBy(*keys).agg(F.array_sort(F.collect_set(col)).alias(f"{col}s"))
    notes = note_segments.groupBy(*keys).agg(F.array_sort(F.collect_set("note_id")).alias("note_ids"))
    out = notes.join(spread(tags, "tag"), keys, "left").join(spread(collections, "collection"), keys, "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"tags": F.coalesce("tags", none), "collections": F.coalesce("collections", none)})


def navigation(usage: DataFrame, name: str, used_at: str, by_recency: bool = False, limit: int = 20) -> DataFrame:
    """name, usage_count, last_used_at of the most used (or most recently used) names."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    counts = usage.groupBy(name).agg(F.count(F.lit(1)).alias("usage_count"), F.max(used_at).alias("last_used_at"))
    first, second = ("last_used_at", "usage_count") if by_recency else ("usage_count", "last_used_at")
    return counts.orderBy(F.desc(first), F.desc(second), name).limit(limit)


def name_matches(dimension: DataFrame, id_col: str, name_col: str, query: str, limit: int) -> DataFrame:
    """Dimension rows that answer a query by name, the best ``limit``: tier, overlap, normalized_name, id."""
    rows = dimension.withColumn("_t", T.name_tier(F.col(name_col), query)).filter("_t IS NOT NULL")
    rows = rows.withColumns({"tier": F.col("_t.tier"), "overlap": F.col("_t.overlap"), "normalized_name": T.squeeze(F.col(name_col))}).drop("_t")
    return rows.orderBy("tier", "overlap", "normalized_name", id_col).limit(limit)


def with_currentness(notes: DataFrame, documents: DataFrame) -> DataFrame:
    """``notes`` with current: the document exists and both digests are still those of the note."""
    now = documents.select("document_id", F.col("canonical_sha256").alias("_c"), F.col("source_sha256").alias("_s"))
    same = F.coalesce((F.col("canonical_sha256") == F.col("_c")) & (F.col("source_sha256") == F.col("_s")), F.lit(False))
    return notes.join(now, "document_id", "left").withColumn("current", same).drop("_c", "_s")


def notes_listing(notes: DataFrame, limit: int = 10_000) -> DataFrame:
    return notes.orderBy(F.desc("updated_at"), "note_id").limit(limit)


def filtered_listing(notes: DataFrame, matched: DataFrame, limit: int) -> DataFrame:
    """Filtered notes come in the order of their ids, unlike :func:`notes_listing`."""
    return notes.join(matched, "note_id", "left_semi").orderBy("note_id").limit(limit)


def by_ids(rows: DataFrame, ids: list, id_col: str) -> DataFrame:
    """Rows of the asked ids (a few) with their place in the request as ``ordinal``; unknown ids are missing."""
    asked = rows.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], f"ordinal int, {id_col} {rows.schema[id_col].dataType.simpleString()}")
    return rows.join(F.broadcast(asked), id_col).orderBy("ordinal")


def get_or_create(dimension: DataFrame, names: DataFrame, id_col: str, name_col: str, source_col: str, order_col: str | None = None) -> DataFrame:
    """New dimension rows for names that no known name equals when folded: the first spelling by ``order_col`` (without it the
    least), and an id from its digest."""
    order = [F.col(order_col).alias("_o")] if order_col else []
    own = names.select(T.squeeze(F.col(source_col)).alias("normalized_name"), F.struct(*order, F.col(source_col).alias("_name")).alias("_first")).filter("normalized_name <> ''")
    fresh = own.groupBy("normalized_name").agg(F.min("_first")["_name"].alias(name_col))
    known = dimension.select(T.squeeze(F.col(name_col)).alias("normalized_name"))
    return fresh.join(known, "normalized_name", "left_anti").select(F.substring(F.sha2("normalized_name", 256), 1, 16).alias(id_col), name_col, "normalized_name")


def overview(notes: DataFrame, limit: int = 20) -> dict[str, DataFrame]:
    """What a workspace opens with: its latest notes (note_id, updated_at, body), and the most used tags and collections.

    ``notes``: note_id, updated_at, body, tag, collection, a row per combination."""
    listing = notes_listing(notes.select("note_id", "updated_at", "body").distinct(), limit)
    used = lambda col: navigation(notes.filter(F.col(col).isNotNull()).select("note_id", "updated_at", col).distinct(), col, "updated_at", limit=min(limit, 100))
    return {"notes": listing, "tags": used("tag"), "collections": used("collection")}


def with_lists(notes: DataFrame, note_segments: DataFrame, tags: DataFrame, collections: DataFrame) -> DataFrame:
    """``notes`` with segment_ids in their order (``ordinal``), and tags and collections by their folded names."""
    spread = lambda side, col: side.groupBy("note_id").agg(F.transform(F.array_sort(F.collect_set(F.struct(T.squeeze(F.col(col)).alias("n"), F.col(col).alias("v")))), lambda x: x["v"]).alias(f"{col}s"))
    ids = note_segments.groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "segment_id"))), lambda x: x["segment_id"]).alias("segment_ids"))
    out = notes.join(ids, "note_id", "left").join(spread(tags, "tag"), "note_id", "left").join(spread(collections, "collection"), "note_id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("segment_ids", "tags", "collections")})


def union_views(summary: DataFrame, passages: DataFrame, keys: list[str]) -> DataFrame:
    """Per passage (passage_id and one row per evidence key): sorted distinct notes, tags and collections of its segments."""
    none = lambda c: F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), F.array())
    met = passages.join(summary, keys, "left")
    return met.groupBy("passage_id").agg(none("note_ids").alias("note_ids"), none("tags").alias("tags"), none("collections").alias("collections"))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
