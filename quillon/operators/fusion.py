"""Hybrid search: lexical and semantic ranks fused by reciprocal rank. Inputs are hits, bounded by the candidate limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rank offset of the fusion (fixed value).
RRF_K = 60


def candidates(limit: int) -> int:
    """How many hits each retriever gives for a final ``limit``."""
    return min(1000, max(5 * limit, 100))


def rrf(*ranks: Column) -> Column:
    total = F.lit(0.0)
    for rank in ranks:
        total = total + F.coalesce(1.0 / (RRF_K + rank), F.lit(0.0))
    return total


def collapse(lexical: DataFrame, segment_chunks: DataFrame) -> DataFrame:
    """Lexical hits (document_id, segment_id, lexical_rank) per chunk: the best rank, ranked anew without gaps, and the matched
    segments by their place in the chunk (``place``; without it by id). Hits without a chunk are dropped; other columns of the
    chunks stay."""
    rest = [c for c in segment_chunks.columns if c not in ("document_id", "segment_id", "chunk_id", "place")]
    place = F.col("place") if "place" in segment_chunks.columns else F.lit(0)
    best = (
        lexical.join(segment_chunks, ["document_id", "segment_id"]).groupBy("chunk_id")
        .agg(F.min("lexical_rank").alias("best"), F.array_sort(F.collect_set(F.struct(place.alias("p"), "segment_id"))).alias("m"), *[F.first(c).alias(c) for c in rest])
    )
    return best.select("chunk_id", F.row_number().over(W.orderBy("best", "chunk_id")).alias("lexical_rank"), F.transform("m", lambda x: x["segment_id"]).alias("matched_segment_ids"), *rest)


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """(chunk_id, lexical_rank, semantic_rank, fused_score, fused_rank, matched_segment_ids), the best ``limit``, and the
    columns of the chunks that both sides have."""
    made = ("chunk_id", "lexical_rank", "semantic_rank", "matched_segment_ids")
    shared = [c for c in lexical.columns if c in semantic.columns and c not in made]
    both = lexical.join(semantic.select("chunk_id", "semantic_rank", *[F.col(c).alias(f"_{c}") for c in shared]), "chunk_id", "full")
    both = both.withColumns({c: F.coalesce(c, f"_{c}") for c in shared}).drop(*[f"_{c}" for c in shared]) if shared else both
    both = both.withColumn("fused_score", rrf(F.col("lexical_rank"), F.col("semantic_rank")))
    placed = both.withColumn("fused_rank", F.row_number().over(W.orderBy(F.desc("fused_score"), "chunk_id")))
    return placed.filter(F.col("fused_rank") <= limit)


def along_timeline(passages: DataFrame) -> DataFrame:
    """Final order by time; ranks keep their values."""
    return passages.orderBy("document_id", "start_seconds", "first_segment_id")
