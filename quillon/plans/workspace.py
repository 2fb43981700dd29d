"""The search and discovery API: one object over the tables of a library."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import fusion, lexical, research, semantic, speakers
from quillon.operators.lexical import SearchQuery
from quillon.sources import generations

LEXICAL, SEMANTIC, HYBRID = "lexical", "semantic", "hybrid"
#: What providers put before a query and before a passage (fixed values).
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


def intent_to_json(query: SearchQuery) -> str:
    return json.dumps({k: v for k, v in asdict(query).items() if k != "terms"}, sort_keys=True, separators=(",", ":"))


def intent_from_json(raw: str) -> SearchQuery:
    """The query of a stored intent; unknown keys are an error."""
    stored = json.loads(raw)
    known = {f.name for f in fields(SearchQuery) if f.init}
    if set(stored) - known:
        raise ValueError(f"unknown keys {sorted(set(stored) - known)}")
    return SearchQuery(**{k: tuple(v) if isinstance(v, list) else v for k, v in stored.items()})


def find_saved(saved: DataFrame, key: str) -> DataFrame:
    """The saved search with this id, else the one with this name (compared folded)."""
    by_id = saved.filter(F.col("saved_search_id").cast("string") == key).withColumn("_p", F.lit(0))
    by_name = saved.filter(T.squeeze(F.col("name")) == " ".join(key.casefold().split())).withColumn("_p", F.lit(1))
    return by_id.unionByName(by_name).orderBy("_p", "saved_search_id").limit(1).drop("_p")


def hashed_vectors(rows: DataFrame, text_col: str = "text", dimensions: int = 64) -> DataFrame:
    """A deterministic stand-in for an embedding model: tokens hashed to signed dimensions, length one. ``rows`` with vector."""
    hashes = F.transform(T.tokens(F.col(text_col)), lambda t: F.xxhash64(t))
    at = lambda h: F.pmod(h, F.lit(dimensions))
    sign = lambda h: F.when(F.shiftright(h, 32).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(F.filter("_h", lambda h: at(h) == d), F.lit(0.0), lambda s, h: s + sign(h)))
    length = V.norm(F.col("_v"))
    first = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.when(d == 0, 1.0).otherwise(0.0))
    return rows.withColumn("_h", hashes).withColumn("_v", raw).withColumn("vector", F.when(length > 0, F.transform("_v", lambda x: x / length)).otherwise(first)).drop("_h", "_v")


def profile_id(model: str, dimensions: int, chunking: str = semantic.CHUNKING_PROFILE) -> str:
    """Names what vectors depend on: the model, its width, the prefixes and the chunking."""
    parts = [model, str(dimensions), QUERY_PREFIX, PASSAGE_PREFIX, chunking]
    return "profile-" + hashlib.sha256("\0".join(parts).encode()).hexdigest()


def rebuild(segments: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, dimensions: int, target: int = semantic.TARGET_WORDS, most: int = semantic.MAX_WORDS) -> DataFrame:
    """Chunks with vectors and the profile they were made by, ready to be published with their bridge.

    ``embed`` adds ``vector`` to rows with ``passage`` (the chunk's text behind its prefix). A vector of another width, not finite
    or not of length one is an error, before anything is stored."""
    rows = embed(semantic.chunks(segments, target, most).withColumn("passage", F.concat(F.lit(PASSAGE_PREFIX), "text"))).drop("passage")
    if bad := rows.filter(~F.coalesce(V.is_valid(F.col("vector"), dimensions), F.lit(False))).select("chunk_id").first():
        raise ValueError(f"the vector of {bad[0]} is not of length one and width {dimensions}")
    return rows.withColumn("profile_id", F.lit(profile_id(model, dimensions)))


def store(spark: SparkSession, root: str, rebuilt: DataFrame, documents: DataFrame) -> str:
    """Publish chunks, bridge and the fingerprint of the documents they were made from, as one generation."""
    return generations.publish(spark, root, {"chunks": rebuilt, "bridge": semantic.bridge(rebuilt), "fingerprint": semantic.fingerprint(documents)})


class Workspace:
    """``segments`` are required; ``chunks`` with vectors, ``notes`` and the rest only for what needs them. With ``labels``
    (document_id, canonical_sha256?, speaker_ref, label) lexical hits tell the speaker's display_name, by the label of their generation. With ``profile`` only chunks of that profile count.

    ``embed_query`` maps a text (with its prefix) to a vector. ``fingerprint`` is that of the documents the vectors were
    made from; semantic search refuses when it is not the present one."""

    def __init__(
        self, segments: DataFrame, chunks: DataFrame | None = None, notes: DataFrame | None = None, note_segments: DataFrame | None = None, labels: DataFrame | None = None,
        embed_query: Callable[[str], list[float]] | None = None, fingerprint: str | None = None, current_fingerprint: str | None = None, profile: str | None = None,
    ) -> None:
        if chunks is not None and profile is not None:
            chunks = chunks.filter(F.col("profile_id") == profile)
        self.segments, self.chunks, self.notes, self.note_segments, self.labels = segments, chunks, notes, note_segments, labels
        self.embed_query, self.fingerprint, self.current_fingerprint = embed_query, fingerprint, current_fingerprint

    def scope(self, tags: list = (), collections: list = (), note_text: str | None = None) -> DataFrame | None:
        """Evidence keys of the notes that match; None without any condition."""
        if not tags and not collections and note_text is None:
            return None
        return research.matching_evidence(research.matching_notes(self.notes, tags, collections, note_text), self.note_segments)

    def search(self, query: SearchQuery, mode: str = LEXICAL, scope: DataFrame | None = None) -> DataFrame:
        if mode == LEXICAL:
            hits = lexical.ranked(lexical.search(self.segments, query, scope), query)
            return hits if self.labels is None else self._named(hits, query)
        if mode not in (SEMANTIC, HYBRID):
            raise ValueError(f"unknown mode {mode}")
        if self.chunks is None or self.embed_query is None:
            raise ValueError("semantic search needs chunks and an embedding provider")
        if self.fingerprint != self.current_fingerprint:
            raise ValueError("vectors are of an older library; rebuild them")
        vector = self.embed_query(QUERY_PREFIX + query.text)
        links = semantic.bridge(self.chunks)
        n = query.limit if mode == SEMANTIC else fusion.candidates(query.limit)
        near = semantic.ranked(semantic.vector_topk(semantic.matches(self.chunks, query, scope, links), vector, n))
        if mode == SEMANTIC:
            return fusion.along_timeline(near) if query.timeline else near.orderBy("semantic_rank")
        wide = SearchQuery(query.text, query.phrase, query.all_terms, query.speaker_refs, query.languages, query.document_ids, False, n)
        hits = lexical.ranked(lexical.search(self.segments, wide, scope), wide).select("document_id", "segment_id", "lexical_rank")
        lex = fusion.collapse(hits, semantic.segment_to_chunk(hits.select("document_id", "segment_id"), semantic.placed_bridge(self.chunks)))
        fused = fusion.fuse(lex, near, query.limit).join(self.chunks.drop("vector"), "chunk_id")
        return fusion.along_timeline(fused) if query.timeline else fused.orderBy("fused_rank")

    def _named(self, hits: DataFrame, query: SearchQuery) -> DataFrame:
        """Hits with label and display_name, in their order. Hits are at most the query's limit; labels are asked for their speakers only."""
        keys = speakers.label_keys(hits, self.labels)
        own = hits.join(self.labels.select(*keys, "label"), keys, "left").withColumn("display_name", T.display_name(F.col("label"), F.col("speaker_ref")))
        return own.orderBy("document_id", "start_seconds", "segment_id") if query.timeline else own.orderBy("lexical_rank")

    def discover(self, text: str, limit: int = 20, mode: str = LEXICAL) -> dict[str, DataFrame]:
        """Evidence, notes, tags and collections that answer a text, each group by its own order."""
        if not 1 <= limit <= 100:
            raise ValueError("limit must be 1 to 100")
        query = SearchQuery(text, limit=limit)
        if mode == LEXICAL:
            scored = lexical.scored(self.segments, query).withColumn("score", F.round("score", 6))
            evidence = lexical.ranked(lexical.ordered(scored, query), query)
        else:
            evidence = self.search(query, mode)
        notes = research.filtered_listing(self.notes, research.matching_notes(self.notes, note_text=text), limit)
        named = lambda col: research.name_matches(self.notes.select(col).distinct().withColumn("id", F.col(col)), "id", col, text, limit)
        return {"evidence": evidence, "note": notes, "tag": named("tag"), "collection": named("collection")}
