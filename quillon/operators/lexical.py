"""Lexical search: BM25 over segments, whose statistics are always those of the whole corpus.

Two ways to the same scores. :func:`search` scans segments: one pass counts the query's terms (a row of statistics), a
second scores each segment by itself, so nothing is shuffled and only the best rows travel. :func:`search_index`
reads an inverted index (:func:`terms`), of which a query touches the rows of its own terms only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import text as T

#: Saturation and length normalisation (fixed values).
K1, B = 1.2, 0.75
SCOPE_KEYS = ["document_id", "canonical_sha256", "segment_id"]


@dataclass(frozen=True)
class SearchQuery:
    """A constrained query. Empty lists do not filter; filters never change scores."""

    text: str
    phrase: str | None = None
    all_terms: bool = False
    speaker_refs: tuple = ()
    languages: tuple = ()
    document_ids: tuple = ()
    timeline: bool = False
    limit: int = 20
    terms: list[str] = field(init=False)

    def __post_init__(self) -> None:
        if not self.text.strip():
            raise ValueError("a query needs text")
        if not 1 <= self.limit <= 1000:
            raise ValueError("limit must be 1 to 1000")
        if self.phrase is not None and not self.phrase.strip():
            raise ValueError("a phrase must not be blank")
        for name in ("speaker_refs", "languages", "document_ids"):
            values = getattr(self, name)
            if len(set(values)) != len(values) or any(isinstance(v, str) and not v.strip() for v in values):
                raise ValueError(f"{name} must be distinct and not blank")
        object.__setattr__(self, "terms", T.query_tokens(self.text))
        if not self.terms:
            raise ValueError("a query needs a word")


def tokenised(segments: DataFrame) -> DataFrame:
    """segments with tokens and token_count."""
    return segments.withColumn("tokens", T.tokens(F.col("text"))).withColumn("token_count", F.size("tokens"))


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` with tokens, in place of which each distinct one stands in a row of its own: term and tf. A row's tokens are sorted and counted where it is; nothing is shuffled."""
    kept = [c for c in rows.columns if c != "tokens"]
    rows = rows.filter(F.size("tokens") > 0).withColumn("_s", F.sort_array("tokens"))
    first = lambda i: (i == 1) | (F.get("_s", i - 1) != F.get("_s", i - 2))
    rows = rows.withColumn("_at", F.filter(F.sequence(F.lit(1), F.size("_s")), first))
    tf = lambda at, k: F.struct(F.get("_s", at - 1).alias("term"), (F.coalesce(F.get("_at", k + 1), F.size("_s") + 1) - at).alias("tf"))
    return rows.select(*kept, F.inline(F.transform("_at", tf)))


def terms(segments: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The inverted index: document_id, segment_id, term, term_frequency, token_count; of ``only`` these terms, if given.

    Texts meet by segment (several of one id count as one), not a row for each of their tokens; terms are then counted within each. Of a few terms the tokens meet, as they
    are fewer than texts."""
    if only is not None:
        own = _matched(segments.select("document_id", "segment_id", "text"), only).select("document_id", "segment_id", "token_count", F.explode("own").alias("term"))
        return own.groupBy("document_id", "segment_id", "term").agg(F.count(F.lit(1)).alias("term_frequency"), F.first("token_count").alias("token_count"))
    texts = segments.groupBy("document_id", "segment_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    rows = counted(tokenised(texts).select("document_id", "segment_id", "token_count", "tokens"))
    return rows.select("document_id", "segment_id", "term", F.col("tf").cast("long").alias("term_frequency"), "token_count")


def corpus_stats(segments: DataFrame) -> DataFrame:
    """One row: segment_count and average_length (0 without segments)."""
    return tokenised(segments).agg(F.count(F.lit(1)).cast("double").alias("segment_count"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("average_length"))


def document_frequency(segments: DataFrame, query_terms: list[str]) -> DataFrame:
    """(term, frequency): in how many segments each of the query's terms occurs; terms that never do are missing."""
    found = F.array_intersect(F.array(*[F.lit(t) for t in query_terms]), T.tokens(F.col("text")))
    return segments.select(F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))


def _weight(n: Column, df: Column, tf: Column, length: Column, average: Column) -> Column:
    rarity = F.log(1.0 + (n - df + 0.5) / (df + 0.5))
    return rarity * (tf * (K1 + 1)) / (tf + K1 * ((1 - B) + B * length / F.nullif(average, F.lit(0.0))))


def filtered(rows: DataFrame, query: SearchQuery, scope: DataFrame | None = None) -> DataFrame:
    """Rows that pass the query's filters. ``scope``: rows of the evidence keys that may answer; None does not
    restrict, an empty one lets nothing pass. The phrase is sought in the folded text as it stands."""
    for name, values in (("speaker_ref", query.speaker_refs), ("language", query.languages), ("document_id", query.document_ids)):
        if values:
            rows = rows.filter(F.col(name).isin(list(values)))
    if query.phrase is not None:
        rows = rows.filter(F.contains(T.fold(F.col("text")), F.lit(query.phrase.strip().casefold())))
    if scope is not None:
        rows = rows.join(scope.select(*SCOPE_KEYS), SCOPE_KEYS, "left_semi")
    return rows


def ordered(rows: DataFrame, query: SearchQuery) -> DataFrame:
    """The first ``limit`` rows by relevance or along the timeline."""
    place = [F.col("document_id"), F.col("start_seconds"), F.col("segment_id")]
    return rows.orderBy(*place if query.timeline else [F.desc("score"), *place]).limit(query.limit)


def _matched(segments: DataFrame, asked: list[str]) -> DataFrame:
    """segments with token_count and own, the tokens that the query asks for.

    Both come out of a generator of one row, below which no later filter is pushed: tokens are made once."""
    rows = segments.withColumn("tokens", T.tokens(F.col("text")))
    return rows.select(*segments.columns, F.inline(F.array(F.struct(F.size("tokens").alias("token_count"), F.filter("tokens", lambda x: x.isin(asked)).alias("own")))))


def scored(segments: DataFrame, query: SearchQuery, scope: DataFrame | None = None) -> DataFrame:
    """All matching segments with matched_terms and score, in no order."""
    asked = query.terms
    stats = _matched(segments.select("text"), asked).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("average"),
        *[F.sum(F.array_contains("own", t).cast("double")).alias(f"df{k}") for k, t in enumerate(asked)],
    )
    rows = _matched(filtered(segments, query, scope), asked).withColumn("matched_terms", F.size(F.array_distinct("own")).cast("long"))
    rows = rows.filter(F.col("matched_terms") >= (len(asked) if query.all_terms else 1)).crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    for k, t in enumerate(asked):
        tf = (F.size("own") - F.size(F.array_remove("own", t))).cast("double")
        total = total + F.when(tf > 0, _weight(F.col("n"), F.col(f"df{k}"), tf, F.col("token_count"), F.col("average"))).otherwise(0.0)
    return rows.select(*segments.columns, "token_count", "matched_terms", total.alias("score"))


def search(segments: DataFrame, query: SearchQuery, scope: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` segments, ties by document, start and segment; ``timeline`` sorts before it limits."""
    return ordered(scored(segments, query, scope), query)


def search_index(index: DataFrame, stats: DataFrame, segments: DataFrame, query: SearchQuery, scope: DataFrame | None = None, places: int | None = None) -> DataFrame:
    """The same answer from an inverted index and its statistics (one row, see :func:`corpus_stats`).

    ``places``: scores are rounded before the limit, as sums over terms in any order differ in the last bit and split ties."""
    own = index.filter(F.col("term").isin(query.terms))
    df = own.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))  # as many rows as the query has terms
    weight = _weight(F.col("segment_count"), F.col("df"), F.col("term_frequency").cast("double"), F.col("token_count"), F.col("average_length"))
    scores = (
        own.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
        .groupBy("document_id", "segment_id").agg(F.count(F.lit(1)).alias("matched_terms"), F.sum(weight).alias("score"))
        .filter(F.col("matched_terms") >= (len(query.terms) if query.all_terms else 1))
    )
    if places is not None:
        scores = scores.withColumn("score", F.round("score", places))
    return ordered(filtered(segments.join(scores, ["document_id", "segment_id"]), query, scope), query)


def ranked(hits: DataFrame, query: SearchQuery) -> DataFrame:
    """Hits (at most ``limit`` rows) with their place; null along the timeline, where places say nothing."""
    if query.timeline:
        return hits.withColumn("lexical_rank", F.lit(None).cast("int"))
    return hits.withColumn("lexical_rank", F.row_number().over(W.orderBy(F.desc("score"), "document_id", "start_seconds", "segment_id")))


def documents_listing(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """Every document with its number of segments, none counted as 0."""
    counts = segments.groupBy("document_id").agg(F.count("segment_id").alias("segment_count"))
    return documents.join(counts, "document_id", "left").withColumn("segment_count", F.coalesce("segment_count", F.lit(0)))
