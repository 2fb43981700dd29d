"""Registered queries: tokens, lexical, semantic and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import fusion, lexical, semantic
from quillon.operators.lexical import SearchQuery
from quillon.plans import sql as S
from quillon.sources import shared, views
from quillon.sources.term_index import TermIndex

QUERIES: dict = {}
ORACLES: dict = {}
ASKED = "the and la und des"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def joined(col: str):
    """An array as text, so that results compare alike everywhere."""
    return F.array_join(F.col(col).cast("array<string>"), "|").alias(col)


def _hits(spark: SparkSession, rows: DataFrame, q: SearchQuery, scope: DataFrame | None = None) -> DataFrame:
    scored = lexical.scored(rows, q, scope).withColumn("score", F.round("score", 6))
    return lexical.ordered(scored, q).select("document_id", "segment_id", "start_seconds", "matched_terms", "score")


def _bm25_sql(terms: list[str], where: str = "matched_terms >= 1", order: str = "score DESC, document_id, start_seconds, segment_id", limit: int = 50, source: str = S.SEGMENTS) -> str:
    return f"""WITH {S.bm25(source, terms)}
  SELECT document_id, segment_id, start_seconds, matched_terms, score FROM sc JOIN seg USING (document_id, segment_id)
  WHERE {where} ORDER BY {order} LIMIT {limit}"""


@query(f"SELECT doc_id AS document_id, len({S.tokens('text')})::BIGINT AS n_tokens, len(list_distinct({S.tokens('text')}))::BIGINT AS n_distinct, greatest(1, len({S.words('text')}))::BIGINT AS n_words FROM documents")
def tokens_stats(spark, sf_dir):
    rows = views.documents(spark, sf_dir).withColumn("t", T.tokens(F.col("text")))
    return rows.select("document_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), T.word_count(F.col("text")).cast("long").alias("n_words"))


@query(f"WITH seg AS ({S.SEGMENTS}) SELECT count(*)::DOUBLE AS segment_count, round(avg(len({S.tokens('text')})), 6) AS average_length FROM seg")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(views.segments(spark, sf_dir)).select("segment_count", F.round("average_length", 6).alias("average_length"))


@query(f"WITH {S.bm25(S.SEGMENTS, ASKED.split())} SELECT term, df::BIGINT AS frequency FROM df")
def term_df(spark, sf_dir):
    return lexical.document_frequency(views.segments(spark, sf_dir), T.query_tokens(ASKED))


@query(f"""WITH seg AS ({S.SEGMENTS}), t AS (SELECT document_id, segment_id, unnest({S.tokens('text')}) AS term FROM seg),
  tf AS (SELECT document_id, segment_id, term, count(*) AS n FROM t GROUP BY ALL)
  SELECT term, count(*) AS segments, sum(n)::BIGINT AS occurrences FROM tf GROUP BY term""")  # fmt: skip
def inverted_index(spark, sf_dir):
    """The index, reduced to its posting list sizes."""
    return lexical.terms(views.segments(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("segments"), F.sum("term_frequency").alias("occurrences"))


@query(_bm25_sql(ASKED.split()))
def bm25_any(spark, sf_dir):
    return _hits(spark, views.segments(spark, sf_dir), SearchQuery(ASKED, limit=50))


@query(_bm25_sql(["the", "and"], "matched_terms >= 2"))
def bm25_all(spark, sf_dir):
    return _hits(spark, views.segments(spark, sf_dir), SearchQuery("The AND the", all_terms=True, limit=50))


@query(_bm25_sql(["of", "the"], f"contains({S.fold('text')}, 'of the')"))
def bm25_phrase(spark, sf_dir):
    return _hits(spark, views.segments(spark, sf_dir), SearchQuery("of the", phrase=" Of The ", limit=50))


@query(_bm25_sql(ASKED.split(), "language IN ('fr', 'de') AND document_id IN (3, 5, 8, 13, 21, 34, 55, 89, 144)"))
def bm25_filtered(spark, sf_dir):
    return _hits(spark, views.segments(spark, sf_dir), SearchQuery(ASKED, languages=("fr", "de"), document_ids=(3, 5, 8, 13, 21, 34, 55, 89, 144), limit=50))


@query(_bm25_sql(ASKED.split(), "speaker_ref IN ('assistant')", source=S.TRANSCRIPTS))
def bm25_speaker_filtered(spark, sf_dir):
    return _hits(spark, views.transcripts(spark, sf_dir), SearchQuery(ASKED, speaker_refs=("assistant",), limit=50))


@query(_bm25_sql(ASKED.split(), "(document_id, segment_id, canonical_sha256) IN (SELECT (b.item_id, 'segment-000000', sha256(d.text)) FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"))
def bm25_scoped(spark, sf_dir):
    """Evidence scope: the first segment of the documents that benchmark items name."""
    docs = views.documents(spark, sf_dir)
    scope = views.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("document_id")).join(docs, "document_id").select("document_id", "canonical_sha256", F.lit("segment-000000").alias("segment_id"))
    return _hits(spark, views.segments(spark, sf_dir, with_sha=True), SearchQuery(ASKED, limit=50), scope)


@query(_bm25_sql(ASKED.split(), "false"))
def bm25_empty_scope(spark, sf_dir):
    rows = views.segments(spark, sf_dir, with_sha=True)
    return _hits(spark, rows, SearchQuery(ASKED, limit=50), rows.filter(F.lit(False)))


@query(_bm25_sql(ASKED.split(), order="document_id, start_seconds, segment_id"))
def bm25_timeline(spark, sf_dir):
    return _hits(spark, views.segments(spark, sf_dir), SearchQuery(ASKED, timeline=True, limit=50))


@query(_bm25_sql(ASKED.split()))
def bm25_indexed(spark, sf_dir):
    """The same hits through an inverted index."""
    rows, q = views.segments(spark, sf_dir), SearchQuery(ASKED, limit=50)
    return lexical.search_index(lexical.terms(rows, q.terms), lexical.corpus_stats(rows), rows, q, places=6).select("document_id", "segment_id", "start_seconds", "matched_terms", "score")


_STORED: dict[tuple[str, str], TermIndex] = {}


def stored_index(spark, sf_dir) -> TermIndex:
    """The index of the documents' segments, built once in a session and then only read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        made = TermIndex(spark, shared.folder(spark, "terms"))
        made.build(views.segments(spark, sf_dir).withColumn("speaker_ref", F.lit(None).cast("string")))
        _STORED[key] = made
    return _STORED[key]


@query(_bm25_sql(ASKED.split()))
def bm25_stored(spark, sf_dir):
    """The same hits from the stored index."""
    return stored_index(spark, sf_dir).search(SearchQuery(ASKED, limit=50), places=6).select("document_id", "segment_id", "start_seconds", "matched_terms", "score")


@query(f"""WITH {S.bm25(S.SEGMENTS, ASKED.split())}, hits AS (SELECT * FROM sc JOIN seg USING (document_id, segment_id) ORDER BY score DESC, document_id, start_seconds, segment_id LIMIT 20)
  SELECT document_id, segment_id, hits.text, language, score, row_number() OVER (ORDER BY score DESC, document_id, start_seconds, segment_id)::INT AS lexical_rank, d.source FROM hits JOIN documents d ON d.doc_id = document_id""")  # fmt: skip
def passage_projection(spark, sf_dir):
    """Hits as passages: decorated with their document, without paths."""
    q = SearchQuery(ASKED, limit=20)
    hits = lexical.ordered(lexical.scored(views.segments(spark, sf_dir), q).withColumn("score", F.round("score", 6)), q)
    source = views.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source")
    return lexical.ranked(hits, q).join(source, "document_id").select("document_id", "segment_id", "text", "language", "score", "lexical_rank", "source")


@query(f"WITH seg AS ({S.SEGMENTS}) SELECT d.doc_id AS document_id, d.lang AS language, count(seg.segment_id) AS segment_count FROM documents d LEFT JOIN seg ON seg.document_id = d.doc_id GROUP BY ALL")
def documents_listing(spark, sf_dir):
    return lexical.documents_listing(views.documents(spark, sf_dir), views.segments(spark, sf_dir)).select("document_id", "language", "segment_count")


# ---- vectors and chunks


def _vectors(spark, sf_dir) -> DataFrame:
    return views.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.array(F.col("label").cast("string")).alias("languages"))


def _query_vector(spark, sf_dir) -> list[float]:
    return views.read(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


_DOT = "round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)"


def _topk(rows: DataFrame, vector: list[float], limit: int) -> DataFrame:
    scores = rows.withColumn("score", F.round(V.dot(F.col("vector"), V.literal(vector)), 6))
    return scores.orderBy(F.desc("score"), "chunk_id").limit(limit).select("chunk_id", "score")


@query(f"SELECT vec_id AS chunk_id, {_DOT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    return _topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 20)


@query("""SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) <= 10""")  # fmt: skip
def vector_topk_many(spark, sf_dir):
    """Every vector whose id is divisible by 100 as a query against all rows."""
    rows = _vectors(spark, sf_dir)
    asked = rows.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return semantic.vector_topk_many(rows, asked, 10, places=6).select("query_id", "chunk_id", "score")


@query(f"SELECT vec_id AS chunk_id, {_DOT} AS score FROM embeddings WHERE label IN (1, 4, 7) ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk_filtered(spark, sf_dir):
    rows = semantic.matches(_vectors(spark, sf_dir), SearchQuery("any", languages=("1", "4", "7")))
    return _topk(rows, _query_vector(spark, sf_dir), 20)


@query("SELECT vec_id AS chunk_id, len(embedding) = 64 AND abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-4 AS valid FROM embeddings")
def vector_validity(spark, sf_dir):
    return _vectors(spark, sf_dir).select("chunk_id", V.is_valid(F.col("vector"), 64).alias("valid"))


@query("SELECT label, count(*) AS n FROM embeddings WHERE list_has_any([label], [0, 2, 9]) GROUP BY label")
def array_overlap_filter(spark, sf_dir):
    rows = semantic.matches(_vectors(spark, sf_dir), SearchQuery("any", languages=("0", "2", "9")))
    return rows.groupBy(F.col("languages")[0].cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


TARGET, MOST = 60, 80
_CHUNKED = f"WITH RECURSIVE tr AS ({S.TRANSCRIPTS}), {S.chunk_numbers(TARGET, MOST)}, chunks AS ({S.CHUNKS})"


def _chunks(spark, sf_dir) -> DataFrame:
    return semantic.chunks(views.transcripts(spark, sf_dir), TARGET, MOST)


@query(_CHUNKED + " SELECT document_id, segment_index, words, chunk_no FROM ch")
def chunk_assignment(spark, sf_dir):
    return semantic.chunk_assignment(views.transcripts(spark, sf_dir), TARGET, MOST)


@query(_CHUNKED + """ SELECT chunk_id, document_id, chunk_no, array_to_string(segment_ids, '|') AS segment_ids, first_segment_id, last_segment_id, start_seconds, end_seconds, text,
  content_sha256, array_to_string(speaker_refs, '|') AS speaker_refs FROM chunks""")  # fmt: skip
def chunk_build(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", "document_id", "chunk_no", joined("segment_ids"), "first_segment_id", "last_segment_id", "start_seconds", "end_seconds", "text", "content_sha256", joined("speaker_refs"))


@query(_CHUNKED + " SELECT chunk_id, document_id, unnest(segment_ids) AS segment_id FROM chunks WHERE chunk_no > 0")
def chunk_bridge_backfill(spark, sf_dir):
    """Bridge rows that are missing when only first chunks have any."""
    rows = _chunks(spark, sf_dir)
    return semantic.missing_bridge(rows, semantic.bridge(rows.filter("chunk_no = 0")))


@query(_CHUNKED + """, b AS (SELECT chunk_id, document_id, unnest(segment_ids) AS segment_id FROM chunks), twice AS (SELECT * FROM b UNION ALL SELECT 'chunk-0', document_id, segment_id FROM b)
  SELECT tr.document_id, tr.segment_id, max(chunk_id) AS chunk_id FROM tr JOIN twice USING (document_id, segment_id) WHERE speaker_ref = 'user' GROUP BY ALL""")  # fmt: skip
def segment_to_chunk(spark, sf_dir):
    """Segments of users with their chunk, where another chunk claims each segment too."""
    links = semantic.bridge(_chunks(spark, sf_dir))
    both = links.unionByName(links.withColumn("chunk_id", F.lit("chunk-0")))
    return semantic.segment_to_chunk(views.transcripts(spark, sf_dir).filter("speaker_ref = 'user'").select("document_id", "segment_id"), both)


@query("SELECT sha256(string_agg(doc_id || chr(0) || sha256(text) || chr(0), '' ORDER BY doc_id::VARCHAR)) AS fingerprint, count(*) AS documents FROM documents")
def corpus_fingerprint(spark, sf_dir):
    return semantic.fingerprint(views.documents(spark, sf_dir))


@query("""WITH r AS (SELECT substr(sha256(doc_id::VARCHAR), 1, 4) AS g, doc_id || chr(0) || sha256(text) || chr(0) AS l FROM documents),
  h AS (SELECT g, sha256(string_agg(l, '' ORDER BY l)) AS h, count(*) AS n FROM r GROUP BY g)
  SELECT sha256(string_agg(g || h, '' ORDER BY g || h)) AS fingerprint, sum(n)::BIGINT AS documents FROM h""")  # fmt: skip
def corpus_fingerprint_tree(spark, sf_dir):
    return semantic.fingerprint_tree(views.documents(spark, sf_dir))


LIMIT = 20


def _fused(spark, sf_dir) -> DataFrame:
    """Chunks are placed over all embeddings by their document and number. What the result tells of a chunk travels with both sides."""
    rows = views.transcripts(spark, sf_dir)
    chunks = semantic.chunks(rows, TARGET, MOST)
    n = fusion.candidates(LIMIT)
    q = SearchQuery(ASKED, limit=n)
    hits = lexical.ranked(lexical.ordered(lexical.scored(rows, q).withColumn("score", F.round("score", 6)), q), q).select("document_id", "segment_id", "lexical_rank")
    told = ["start_seconds", "first_segment_id"]
    links = semantic.placed_bridge(chunks.withColumn("_doc", F.col("document_id")), "_doc", *told)
    lex = fusion.collapse(hits, semantic.segment_to_chunk(hits.select("document_id", "segment_id"), links)).withColumnRenamed("_doc", "document_id")
    vectors = views.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    placed = chunks.withColumn("_v", (F.col("document_id") * 31 + F.col("chunk_no")) % vectors.count()).join(vectors, "_v")
    scores = placed.withColumn("score", F.round(V.dot(F.col("vector"), V.literal(_query_vector(spark, sf_dir))), 6))
    near = scores.select("chunk_id", "document_id", *told, "score").orderBy(F.desc("score"), "document_id", "start_seconds", "chunk_id").limit(n)
    return fusion.fuse(lex, semantic.ranked(near), LIMIT).withColumn("fused_score", F.round("fused_score", 9))


_HYBRID = f"""WITH RECURSIVE tr AS ({S.TRANSCRIPTS}), {S.chunk_numbers(TARGET, MOST)}, chunks AS ({S.CHUNKS}), {S.bm25('SELECT * FROM tr', ASKED.split())},
  hits AS (SELECT document_id, segment_id, row_number() OVER (ORDER BY score DESC, document_id, start_seconds, segment_id) AS r FROM sc JOIN seg USING (document_id, segment_id)
           ORDER BY score DESC, document_id, start_seconds, segment_id LIMIT 100),
  b AS (SELECT chunk_id, document_id, unnest(segment_ids) AS segment_id FROM chunks),
  best AS (SELECT chunk_id, min(r) AS best, list_sort(list_distinct(list(segment_id))) AS matched FROM hits JOIN b USING (document_id, segment_id) GROUP BY chunk_id),
  lex AS (SELECT chunk_id, row_number() OVER (ORDER BY best, chunk_id)::INT AS lexical_rank, matched FROM best),
  v AS (SELECT chunk_id, document_id, start_seconds, {_DOT} AS s FROM chunks JOIN embeddings ON vec_id = (document_id * 31 + chunk_no) % (SELECT count(*) FROM embeddings)),
  sem AS (SELECT chunk_id, row_number() OVER (ORDER BY s DESC, document_id, start_seconds, chunk_id)::INT AS semantic_rank FROM v ORDER BY s DESC, document_id, start_seconds, chunk_id LIMIT 100),
  fused AS (SELECT chunk_id, lexical_rank, semantic_rank, matched, coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) AS score FROM lex FULL JOIN sem USING (chunk_id)),
  placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS fused_rank FROM fused)
  SELECT chunk_id, document_id, lexical_rank, semantic_rank, round(score, 9) AS fused_score, fused_rank, array_to_string(matched, '|') AS matched_segment_ids
  FROM placed JOIN chunks USING (chunk_id) WHERE fused_rank <= {LIMIT}"""
_FUSED = ["chunk_id", "document_id", "lexical_rank", "semantic_rank", "fused_score", "fused_rank"]


@query(_HYBRID)
def hybrid_rrf(spark, sf_dir):
    return _fused(spark, sf_dir).select(*_FUSED, joined("matched_segment_ids"))


@query(_HYBRID + " ORDER BY document_id, start_seconds, first_segment_id")
def hybrid_rrf_timeline(spark, sf_dir):
    """Relevance picks, time sorts; ranks stay."""
    return fusion.along_timeline(_fused(spark, sf_dir)).select(*_FUSED, joined("matched_segment_ids"))
