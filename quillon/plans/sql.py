"""Parts of the DuckDB SQL that several queries share: the corpus views, tokens and words."""

from __future__ import annotations

from quillon.functions.text import SPACE, TOKEN


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def tokens(x: str) -> str:
    quoted = TOKEN.replace("'", "''")
    return f"regexp_extract_all({fold(x)}, '{quoted}')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{SPACE}]+')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+\\z', '', 'g')"


def clock(ms: str, separator: str) -> str:
    return f"printf('%02d:%02d:%02d{separator}%03d', ({ms}) // 3600000, ({ms}) // 60000 % 60, ({ms}) // 1000 % 60, ({ms}) % 1000)"


def ms(x: str, how: str) -> str:
    return f"{how}(CAST(CAST({x} AS VARCHAR) AS DECIMAL(20,9)) * 1000)::BIGINT"


#: segments of documents
SEGMENTS = f"""
  SELECT doc_id AS document_id, (idx - 1)::INT AS segment_index, printf('segment-%06d', idx - 1) AS segment_id, line AS text, lang AS language,
         5.0::DOUBLE * (idx - 1) AS start_seconds, 5.0::DOUBLE * (idx - 1) + 5 AS end_seconds, sha256(doc) AS canonical_sha256
  FROM (SELECT doc_id, lang, text AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents)
  WHERE regexp_matches(line, '[^{SPACE}]')"""
#: transcripts of conversations
TRANSCRIPTS = """
  SELECT conv_id AS document_id, turn AS segment_index, printf('segment-%06d', turn) AS segment_id, text, role AS speaker_ref,
         coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 8.0::DOUBLE AS start_seconds,
         sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 8.0::DOUBLE AS end_seconds
  FROM conversations"""
#: turns and words of the transcripts in tr
TURNS = "SELECT document_id, speaker_ref, start_seconds, end_seconds + 2 AS end_seconds FROM tr"
WORDS = f"""
  SELECT document_id, segment_index, segment_id, (k - 1)::INT AS word_index, word, s + (k - 1) / 8.0::DOUBLE AS start_seconds, s + (k - 1) / 8.0::DOUBLE + 0.125::DOUBLE AS end_seconds
  FROM (SELECT document_id, segment_index, segment_id, start_seconds AS s, unnest({words('text')}) AS word, generate_subscripts({words('text')}, 1) AS k FROM tr)"""
#: notes of events
NOTES = """
  SELECT event_id AS note_id, user_id AS document_id, event_type AS tag, strftime(ts, '%Y-%m-%d') AS collection, ts AS updated_at, event_type || ' ' || props AS body FROM events"""


def chunk_numbers(target: int, most: int) -> str:
    """CTEs w and ch over tr: (document_id, segment_index, words, chunk_no). Needs WITH RECURSIVE."""
    return f"""
  w AS (SELECT document_id, segment_index, greatest(1, len({words('text')}))::BIGINT AS words, row_number() OVER (PARTITION BY document_id ORDER BY segment_index) AS rn FROM tr),
  ch AS (
    SELECT document_id, segment_index, words, rn, 0 AS chunk_no, CASE WHEN words >= {most} THEN 0 ELSE words END AS cur, CASE WHEN words >= {most} THEN 0 ELSE 1 END AS n,
           CASE WHEN words >= {most} THEN 1 ELSE 0 END AS nxt FROM w WHERE rn = 1
    UNION ALL
    SELECT document_id, segment_index, words, rn, (nxt + c)::INT, CASE WHEN nc >= {most} THEN 0 ELSE nc END, CASE WHEN nc >= {most} THEN 0 ELSE 1 END, (nxt + c + CASE WHEN nc >= {most} THEN 1 ELSE 0 END)::INT
    FROM (SELECT w.document_id, w.segment_index, w.words, w.rn, ch.nxt,
                 CASE WHEN ch.n > 0 AND (ch.cur >= {target} OR ch.cur + w.words > {most}) THEN 1 ELSE 0 END AS c,
                 CASE WHEN ch.n > 0 AND (ch.cur >= {target} OR ch.cur + w.words > {most}) THEN w.words ELSE ch.cur + w.words END AS nc
          FROM ch JOIN w ON w.document_id = ch.document_id AND w.rn = ch.rn + 1))"""


#: chunks of tr, after chunk_numbers
CHUNKS = f"""
  SELECT *, 'chunk-' || sha256('chunks-v1' || chr(0) || document_id || chr(0) || first_segment_id || chr(0) || last_segment_id || chr(0) || content_sha256) AS chunk_id
  FROM (SELECT *, sha256(text) AS content_sha256 FROM (
    SELECT document_id, chunk_no, list(segment_id ORDER BY segment_index) AS segment_ids, first(segment_id ORDER BY segment_index) AS first_segment_id, last(segment_id ORDER BY segment_index) AS last_segment_id,
           first(start_seconds ORDER BY segment_index) AS start_seconds, last(end_seconds ORDER BY segment_index) AS end_seconds, string_agg({strip('text')}, ' ' ORDER BY segment_index) AS text,
           list_sort(list_distinct(list(speaker_ref))) AS speaker_refs
    FROM tr JOIN ch USING (document_id, segment_index) GROUP BY document_id, chunk_no))"""


def bm25(source: str, terms: list[str]) -> str:
    """CTEs seg, tk, corpus, q, tf, df, sc: sc has document_id, segment_id, matched_terms, score for every segment that matches."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
  seg AS ({source}),
  tk AS (SELECT document_id, segment_id, {tokens('text')} AS tokens FROM seg),
  corpus AS (SELECT count(*)::DOUBLE AS n, coalesce(avg(len(tokens)), 0)::DOUBLE AS average FROM tk),
  q AS (SELECT unnest([{listed}]) AS term),
  tf AS (SELECT document_id, segment_id, term, len(tokens) AS size, len(list_filter(tokens, lambda x: x = term))::DOUBLE AS tf FROM tk, q WHERE list_contains(tokens, term)),
  df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
  sc AS (SELECT document_id, segment_id, count(*) AS matched_terms,
                round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / nullif(average, 0)))), 6) AS score
         FROM tf JOIN df USING (term), corpus GROUP BY document_id, segment_id)"""
