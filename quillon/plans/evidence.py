"""Registered queries: speakers, highlights, anchors, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import evidence, language, speakers
from quillon.plans import sql as S
from quillon.plans.search import joined
from quillon.sources import views

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_TR = f"tr AS ({S.TRANSCRIPTS}), turns AS ({S.TURNS})"
_TRW = f"{_TR}, words AS ({S.WORDS})"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.turns(views.transcripts(spark, sf_dir))


@query(f"""WITH {_TR} SELECT tr.document_id, tr.segment_id, array_to_string(list_sort(list_distinct(list(t.speaker_ref))), '|') AS active, round(sum(least(tr.end_seconds, t.end_seconds) - greatest(tr.start_seconds, t.start_seconds)), 6) AS seconds
  FROM tr JOIN turns t ON t.document_id = tr.document_id AND least(tr.end_seconds, t.end_seconds) > greatest(tr.start_seconds, t.start_seconds) GROUP BY ALL""")  # fmt: skip
def speaker_overlap(spark, sf_dir):
    """Which speakers' turns overlap each segment, and for how long in all."""
    from quillon.functions.time import overlap_seconds
    from quillon.operators.intervals import overlap_join

    rows = views.transcripts(spark, sf_dir)
    other = views.turns(rows).select("document_id", F.col("speaker_ref").alias("ref"), F.col("start_seconds").alias("ts"), F.col("end_seconds").alias("te"))
    met = overlap_join(rows.select("document_id", "segment_id", "start_seconds", "end_seconds"), other, ["document_id"], ("start_seconds", "end_seconds"), ("ts", "te"))
    seconds = overlap_seconds(F.col("start_seconds"), F.col("end_seconds"), F.col("ts"), F.col("te"))
    return met.groupBy("document_id", "segment_id").agg(F.array_join(F.array_sort(F.collect_set("ref")), "|").alias("active"), F.round(F.sum(seconds), 6).alias("seconds"))


_PROJECTED = f"""WITH {_TRW}, p AS (SELECT w.document_id, w.segment_id, w.word_index, list_distinct(list(t.speaker_ref)) AS refs FROM words w LEFT JOIN turns t
  ON t.document_id = w.document_id AND least(w.end_seconds, t.end_seconds) > greatest(w.start_seconds, t.start_seconds) GROUP BY ALL),
  r AS (SELECT document_id, segment_id, word_index, CASE WHEN len(refs) = 1 THEN refs[1] END AS speaker_ref FROM p)"""


@query(_PROJECTED + """ SELECT document_id, segment_id, CASE WHEN count(*) = count(speaker_ref) AND count(DISTINCT speaker_ref) = 1 THEN min(speaker_ref) END AS speaker_ref,
  count(speaker_ref) AS attributed, count(*) AS words FROM r GROUP BY document_id, segment_id""")  # fmt: skip
def speaker_projection(spark, sf_dir):
    """Words take the one speaker that overlaps them; a segment takes the one that all its words have."""
    rows = views.transcripts(spark, sf_dir)
    words = speakers.project(views.words(rows), views.turns(rows), ["document_id", "segment_id", "word_index"])
    counts = words.groupBy("document_id", "segment_id").agg(F.count("speaker_ref").alias("attributed"), F.count(F.lit(1)).alias("words"))
    return speakers.segment_refs(words).join(counts, ["document_id", "segment_id"])


@query(f"""WITH {_TRW}, p AS (SELECT w.document_id, w.segment_id, w.word_index, w.word, w.start_seconds, w.end_seconds, list_sort(coalesce(list_distinct(list(t.speaker_ref)), [])) AS active FROM words w LEFT JOIN turns t
  ON t.document_id = w.document_id AND least(w.end_seconds, t.end_seconds) > greatest(w.start_seconds, t.start_seconds) GROUP BY ALL),
  g AS (SELECT p.*, CASE WHEN word_index % 5 <> 4 THEN tr.speaker_ref END AS given FROM p JOIN tr USING (document_id, segment_id)),
  k AS (SELECT *, CASE WHEN len(active) > 1 THEN 'overlap' WHEN given IS NOT NULL THEN 'single-speaker' ELSE 'unattributed' END AS kind,
          array_to_string(CASE WHEN len(active) > 1 THEN active WHEN given IS NOT NULL THEN [given] ELSE [] END, '|') AS refs FROM g),
  c AS (SELECT *, CASE WHEN (kind || ':' || refs) IS DISTINCT FROM lag(kind || ':' || refs) OVER (PARTITION BY document_id, segment_id ORDER BY word_index) THEN 1 ELSE 0 END AS changed FROM k),
  s AS (SELECT *, sum(changed) OVER (PARTITION BY document_id, segment_id ORDER BY word_index ROWS UNBOUNDED PRECEDING) AS span_no FROM c)
  SELECT document_id, segment_id, span_no::BIGINT AS span_no, first(kind) AS kind, first(refs) AS speaker_refs, min(start_seconds) AS start_seconds, max_by(end_seconds, word_index) AS end_seconds,
    {S.strip("string_agg(word, '' ORDER BY word_index)")} AS text FROM s GROUP BY document_id, segment_id, span_no""")  # fmt: skip
def speaker_spans(spark, sf_dir):
    """Presentation spans where every fifth word lacks its canonical speaker."""
    rows = views.transcripts(spark, sf_dir)
    given = rows.select("document_id", "segment_id", F.col("speaker_ref").alias("given"))
    words = views.words(rows).join(given, ["document_id", "segment_id"]).withColumn("speaker_ref", F.when(F.col("word_index") % 5 != 4, F.col("given"))).drop("given")
    return speakers.word_spans(words, views.turns(rows)).select("document_id", "segment_id", "span_no", "kind", joined("speaker_refs"), "start_seconds", "end_seconds", "text")


@query(f"""WITH {_TR}, own AS (SELECT *, CASE WHEN segment_index % 3 = 0 THEN speaker_ref END AS given FROM tr),
  a AS (SELECT own.document_id, own.segment_id, list_sort(coalesce(list_distinct(list(t.speaker_ref)), [])) AS active FROM own LEFT JOIN turns t
        ON t.document_id = own.document_id AND least(own.end_seconds, t.end_seconds) > greatest(own.start_seconds, t.start_seconds) GROUP BY ALL),
  b AS (SELECT DISTINCT own.document_id, own.segment_id FROM own JOIN turns x ON x.document_id = own.document_id JOIN turns y ON y.document_id = own.document_id AND x.speaker_ref < y.speaker_ref
        AND least(own.end_seconds, x.end_seconds, y.end_seconds) > greatest(own.start_seconds, x.start_seconds, y.start_seconds))
  SELECT own.document_id, own.segment_id, CASE WHEN given IS NOT NULL THEN 'single-speaker' WHEN len(active) <= 1 THEN 'unattributed' WHEN b.segment_id IS NOT NULL THEN 'overlap' ELSE 'mixed-unresolved' END AS kind,
    array_to_string(CASE WHEN given IS NOT NULL THEN [given] WHEN len(active) <= 1 THEN [] ELSE active END, '|') AS speaker_refs
  FROM own JOIN a USING (document_id, segment_id) LEFT JOIN b USING (document_id, segment_id)""")  # fmt: skip
def segment_classification(spark, sf_dir):
    """Segments without words: two of three have no canonical speaker."""
    rows = views.transcripts(spark, sf_dir)
    own = rows.withColumn("speaker_ref", F.when(F.col("segment_index") % 3 == 0, F.col("speaker_ref")))
    return speakers.segment_spans(own, views.turns(rows)).select("document_id", "segment_id", "kind", joined("speaker_refs"))


_LABELS = "labels_view AS (SELECT DISTINCT conv_id AS document_id, role AS speaker_ref, 'Person ' || upper(substr(role, 1, 1)) AS label, CASE WHEN conv_id % 2 = 0 THEN 'now' ELSE 'old' END AS canonical_sha256 FROM conversations WHERE role <> 'system')"


def _labels(spark, sf_dir) -> DataFrame:
    rows = views.transcripts(spark, sf_dir).filter("speaker_ref <> 'system'").select("document_id", "speaker_ref").distinct()
    return rows.select(
        "document_id", "speaker_ref", F.concat(F.lit("Person "), F.upper(F.substring("speaker_ref", 1, 1))).alias("label"), F.when(F.col("document_id") % 2 == 0, "now").otherwise("old").alias("canonical_sha256")
    )


@query(f"""WITH {_LABELS} SELECT DISTINCT c.conv_id AS document_id, c.role AS speaker_ref, l.label, CASE WHEN l.label IS NULL THEN c.role ELSE l.label || ' (' || c.role || ')' END AS display_name
  FROM conversations c LEFT JOIN labels_view l ON l.document_id = c.conv_id AND l.speaker_ref = c.role""")  # fmt: skip
def speaker_roster(spark, sf_dir):
    return speakers.roster(views.transcripts(spark, sf_dir), _labels(spark, sf_dir))


@query(f"WITH {_LABELS} SELECT document_id, speaker_ref, label, document_id % 2 = 0 AS current FROM labels_view")
def label_views(spark, sf_dir):
    docs = views.transcripts(spark, sf_dir).select("document_id").distinct().withColumn("canonical_sha256", F.lit("now"))
    return speakers.label_views(_labels(spark, sf_dir), docs).select("document_id", "speaker_ref", "label", "current")


@query(f"WITH {_LABELS} SELECT document_id, speaker_ref, label, length(label) <= 200 AS valid FROM labels_view WHERE document_id = 4 AND canonical_sha256 = 'now' AND speaker_ref = 'user'")
def label_resolve(spark, sf_dir):
    rows = _labels(spark, sf_dir).filter("document_id = 4 AND canonical_sha256 = 'now' AND speaker_ref = 'user'")
    return rows.select("document_id", "speaker_ref", "label", T.label_is_valid(F.col("label")).alias("valid"))


@query(f"""WITH {_TR}, f AS (SELECT document_id, speaker_ref AS label, min((start_seconds, end_seconds)) AS m FROM turns GROUP BY ALL)
  SELECT document_id, label, printf('speaker-%02d', row_number() OVER (PARTITION BY document_id ORDER BY m, label)) AS speaker_ref FROM f""")  # fmt: skip
def speaker_numbering(spark, sf_dir):
    turns = _turns(spark, sf_dir).withColumnRenamed("speaker_ref", "label")
    return speakers.numbered(turns).select("document_id", "label", "speaker_ref").distinct()


# ---- context and highlights


@query(f"""WITH {_TR}, hits AS (SELECT document_id || ':' || segment_index AS hit_id, document_id, segment_index AS i FROM tr WHERE speaker_ref = 'system')
  SELECT hit_id, tr.document_id, tr.segment_id, tr.segment_index = hits.i AS is_match FROM hits JOIN tr ON tr.document_id = hits.document_id AND tr.segment_index BETWEEN hits.i - 2 AND hits.i + 2""")  # fmt: skip
def context_window(spark, sf_dir):
    rows = views.transcripts(spark, sf_dir)
    hits = rows.filter("speaker_ref = 'system'").select(
        F.concat_ws(":", F.col("document_id").cast("string"), F.col("segment_index").cast("string")).alias("hit_id"), "document_id", F.col("segment_index").alias("first_index"), F.col("segment_index").alias("last_index")
    )
    return evidence.context(hits, rows, 2).select("hit_id", "document_id", "segment_id", "is_match")


_FLAT = f"""flat AS (SELECT document_id, segment_id, word_index, start_seconds, unnest({S.tokens('word')}) AS token, generate_subscripts({S.tokens('word')}, 1) AS k FROM words),
  placed AS (SELECT *, row_number() OVER (PARTITION BY document_id, segment_id ORDER BY word_index, k) AS p FROM flat)"""
_MARKED = """, m AS (SELECT document_id, segment_id, list_sort(list_distinct(list(word_index))) AS h, min_by(start_seconds, word_index) AS s FROM marks GROUP BY ALL)
  SELECT tr.document_id, tr.segment_id, coalesce(array_to_string(h, '|'), '') AS highlighted, coalesce(s, tr.start_seconds) AS seek_seconds FROM tr LEFT JOIN m USING (document_id, segment_id)"""


@query(f"WITH {_TRW}, {_FLAT}, marks AS (SELECT * FROM placed WHERE token IN ('the', 'la', 'und'))" + _MARKED)
def highlight_terms(spark, sf_dir):
    rows = views.transcripts(spark, sf_dir)
    return evidence.highlights(rows, views.words(rows), "The la und").select("document_id", "segment_id", joined("highlighted"), "seek_seconds")


@query(f"""WITH {_TRW}, {_FLAT}, starts AS (SELECT a.document_id, a.segment_id, a.p FROM placed a JOIN placed b ON a.document_id = b.document_id AND a.segment_id = b.segment_id AND b.p = a.p + 1 WHERE a.token = 'de' AND b.token = 'la'),
  marks AS (SELECT placed.* FROM placed JOIN starts s ON s.document_id = placed.document_id AND s.segment_id = placed.segment_id AND placed.p IN (s.p, s.p + 1))""" + _MARKED)  # fmt: skip
def highlight_phrase(spark, sf_dir):
    rows = views.transcripts(spark, sf_dir)
    return evidence.highlights(rows, views.words(rows), "de LA", phrase=True).select("document_id", "segment_id", joined("highlighted"), "seek_seconds")


# ---- anchors


@query(f"""WITH {_TR}, n AS (SELECT document_id, count(*) AS n, max(segment_index) AS last FROM tr GROUP BY ALL)
  SELECT document_id || '-' || v AS anchor_id, document_id, CASE v WHEN 'gap' THEN last >= 2 WHEN 'missing' THEN false ELSE last >= 1 END AS found, v = 'run' AND last >= 1 AS contiguous,
    CASE v WHEN 'gap' THEN last >= 2 WHEN 'missing' THEN false WHEN 'back' THEN last >= 1 ELSE last >= 1 END AS in_time
  FROM n, (VALUES ('run'), ('gap'), ('back'), ('missing')) t(v)""")  # fmt: skip
def anchor_contiguity(spark, sf_dir):
    """Four anchors per document: two neighbours, two with a gap, two in the wrong order, one that does not exist."""
    rows = views.transcripts(spark, sf_dir)
    kinds = {"run": [0, 1], "gap": [0, 2], "back": [1, 0], "missing": [0, 900_000]}
    parts = F.array(*[F.struct(F.lit(k).alias("v"), F.array(*[F.lit(f"segment-{i:06d}") for i in ids]).alias("segment_ids")) for k, ids in kinds.items()])
    anchors = rows.select("document_id").distinct().select("document_id", F.explode(parts).alias("a")).select(
        F.concat_ws("-", F.col("document_id").cast("string"), "a.v").alias("anchor_id"), "document_id", "a.segment_ids", F.lit(0.0).alias("start_seconds"), F.lit(0.25).alias("end_seconds")
    )
    return evidence.anchor_checks(anchors, rows)


_ANCHORED = f"""WITH {_TR}, docs AS (SELECT DISTINCT document_id FROM tr),
  notes AS (SELECT event_id AS note_id, user_id AS document_id, CASE WHEN event_id % 3 = 0 THEN 'now' ELSE 'old' END AS c, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE 'source' END AS s,
            (event_id % 97) / 2.0::DOUBLE AS ns, (event_id % 97) / 2.0::DOUBLE + (event_id % 4) * 4 AS ne FROM events),
  old AS (SELECT notes.* FROM notes JOIN docs USING (document_id) WHERE c <> 'now' AND s = 'source'),
  hit AS (SELECT old.*, tr.segment_index, tr.segment_id, tr.start_seconds AS ts, tr.end_seconds AS te FROM old JOIN tr ON tr.document_id = old.document_id
          AND CASE WHEN ns = ne THEN tr.start_seconds <= ns AND ns <= tr.end_seconds ELSE tr.end_seconds > ns AND tr.start_seconds < ne END),
  cand AS (SELECT note_id, document_id, string_agg(segment_id, '|' ORDER BY segment_index) AS segment_ids, greatest(first(ns), min_by(ts, segment_index)) AS candidate_start, least(first(ne), max_by(te, segment_index)) AS candidate_end FROM hit GROUP BY ALL)"""


def _anchored(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = views.transcripts(spark, sf_dir)
    docs = rows.select("document_id").distinct().select("document_id", F.lit("now").alias("canonical_sha256"), F.lit("source").alias("source_sha256"))
    start = (F.col("note_id") % 97) / 2.0
    notes = views.notes(spark, sf_dir).select(
        "note_id", "document_id", F.when(F.col("note_id") % 3 == 0, "now").otherwise("old").alias("canonical_sha256"), F.when(F.col("note_id") % 5 == 0, "other").otherwise("source").alias("source_sha256"),
        start.alias("start_seconds"), (start + (F.col("note_id") % 4) * 4).alias("end_seconds"),
    )
    return notes, docs, evidence.candidate_anchors(notes, docs, rows)


@query(_ANCHORED + " SELECT note_id, document_id, segment_ids, candidate_start, candidate_end FROM cand WHERE candidate_end >= candidate_start")
def anchor_candidate(spark, sf_dir):
    return _anchored(spark, sf_dir)[2].select("note_id", "document_id", joined("segment_ids"), "candidate_start", "candidate_end")


@query(_ANCHORED + """ SELECT n.note_id, CASE WHEN d.document_id IS NOT NULL AND n.c = 'now' AND n.s = 'source' THEN 'current_verified' WHEN k.note_id IS NOT NULL THEN 'older_verified' ELSE 'unavailable' END AS status
  FROM notes n LEFT JOIN docs d USING (document_id) LEFT JOIN (SELECT note_id FROM cand WHERE candidate_end >= candidate_start) k ON k.note_id = n.note_id""")  # fmt: skip
def anchor_review(spark, sf_dir):
    notes, docs, candidates = _anchored(spark, sf_dir)
    return evidence.review(notes, docs, candidates).select("note_id", "status")


# ---- languages

_UNITS = f"""u AS (SELECT doc_id AS document_id, unnest(x) AS raw, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?;:,\\n]*[.!?;:,\\n]|[^.!?;:,\\n]+') AS x FROM documents)),
  p AS (SELECT document_id, raw, k, coalesce(sum(length(raw)) OVER (PARTITION BY document_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
        length(raw) - length(regexp_replace(raw, '^[{S.SPACE}]+', '')) AS skip, {S.strip('raw')} AS unit FROM u),
  units AS (SELECT document_id, (pos + skip)::BIGINT AS start_char, (pos + skip + length(unit))::BIGINT AS end_char, unit FROM p WHERE unit <> '')"""


@query(f"WITH {_UNITS} SELECT document_id, start_char, end_char, unit FROM units")
def language_units(spark, sf_dir):
    return language.text_units(views.documents(spark, sf_dir))


def _spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Segments that are all lines of a document, and units that take turns in two languages, cut by halves of 1000 characters."""
    docs = views.documents(spark, sf_dir)
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("segment_index", "text")).withColumn("segment_id", F.format_string("segment-%06d", "segment_index"))
    spans = language.text_units(docs).select("document_id", "start_char", "end_char", F.when(F.floor(F.col("start_char") / 500) % 2 == 0, "aa").otherwise("bb").alias("language"), F.lit(0.5).alias("confidence"))
    return lines, spans


_PROJECT = f"""WITH {_UNITS}, spans AS (SELECT document_id, start_char, end_char, CASE WHEN start_char // 500 % 2 = 0 THEN 'aa' ELSE 'bb' END AS language FROM units),
  lines AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  b AS (SELECT document_id, line, printf('segment-%06d', i - 1) AS segment_id, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM lines),
  j AS (SELECT b.document_id, segment_id, language, greatest(s, start_char) - s AS a, substr(line, (greatest(s, start_char) - s + 1)::BIGINT, (least(s + length(line), end_char) - greatest(s, start_char))::BIGINT) AS part
        FROM b JOIN spans ON spans.document_id = b.document_id AND least(s + length(line), end_char) > greatest(s, start_char)),
  pr AS (SELECT document_id, segment_id, (a + length(part) - length(regexp_replace(part, '^[{S.SPACE}]+', '')))::BIGINT AS start_char,
         (a + length(part) - length(regexp_replace(part, '^[{S.SPACE}]+', '')) + length({S.strip('part')}))::BIGINT AS end_char, language FROM j WHERE {S.strip('part')} <> '')"""


@query(_PROJECT + " SELECT document_id, segment_id, start_char, end_char, language FROM pr")
def language_projection(spark, sf_dir):
    return language.project_spans(*_spans(spark, sf_dir)).select("document_id", "segment_id", "start_char", "end_char", "language")


@query(_PROJECT + " SELECT document_id, segment_id, CASE WHEN count(DISTINCT language) = 1 THEN min(language) END AS language FROM pr GROUP BY document_id, segment_id")
def segment_languages(spark, sf_dir):
    return language.segment_languages(language.project_spans(*_spans(spark, sf_dir)))


@query(_PROJECT + """, f AS (SELECT document_id, language, min((segment_id, start_char)) AS m FROM pr GROUP BY ALL)
  SELECT document_id, string_agg(language, '|' ORDER BY m) AS detected_languages, CASE WHEN count(*) = 1 THEN min(language) END AS detected_language FROM f GROUP BY document_id""")  # fmt: skip
def detected_languages(spark, sf_dir):
    rows = language.detected_languages(language.project_spans(*_spans(spark, sf_dir)), ["segment_id", "start_char"])
    return rows.select("document_id", joined("detected_languages"), "detected_language")


#: Frequent words of three languages, by which the query below attributes units.
_COMMON = (("de", ("der", "die", "und", "ist", "das")), ("en", ("the", "and", "is", "of", "to")), ("fr", ("la", "les", "et", "est", "des")))


def common_words() -> language.CommonWords:
    return language.CommonWords(dict(_COMMON))


_HITS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)})))::DOUBLE AS n_{name}" for name, words in _COMMON)
_ATTRIBUTED = f"""WITH {_UNITS}, w AS (SELECT document_id, start_char, end_char, list_transform(regexp_extract_all(unit, '[A-Za-z]+'), lambda x: lower(x)) AS w FROM units),
  h AS (SELECT document_id, start_char, end_char, {_HITS} FROM w), m AS (SELECT *, greatest(n_de, n_en, n_fr) AS most, n_de + n_en + n_fr AS whole FROM h),
  spans AS (SELECT document_id, start_char, end_char, CASE most WHEN n_de THEN 'de' WHEN n_en THEN 'en' ELSE 'fr' END AS language, round(most / whole, 9) AS confidence FROM m
    WHERE most > 0 AND (n_de = most)::INT + (n_en = most)::INT + (n_fr = most)::INT = 1)"""


@query(_ATTRIBUTED + " SELECT document_id, start_char, end_char, language, confidence FROM spans")
def attributed_spans(spark, sf_dir):
    """Units of every text with the language that their frequent words tell."""
    units = language.text_units(views.documents(spark, sf_dir))
    return language.attributed(units, common_words).withColumn("confidence", F.round("confidence", 9))


@query("""WITH a AS (SELECT o_orderkey % 7 AS document_id, o_orderkey AS i, o_orderkey::DOUBLE AS s, o_orderkey + pow(2, o_orderkey % 19) / 8 AS e FROM orders),
  b AS (SELECT c_custkey % 7 AS document_id, c_custkey AS j, c_custkey * 4.0::DOUBLE AS ts, c_custkey * 4 + pow(2, c_custkey % 23) / 64 AS te FROM customer)
  SELECT j, count(*) AS n, round(sum(least(e, te) - greatest(s, ts)), 3) AS shared FROM a JOIN b ON a.document_id = b.document_id AND least(e, te) > greatest(s, ts) GROUP BY j""")  # fmt: skip
def mixed_intervals(spark, sf_dir):
    """Orders and customers as intervals whose lengths differ by a factor of millions, joined where they overlap."""
    from quillon.operators.intervals import overlap_join

    key, own = F.col("o_orderkey"), F.col("c_custkey")
    a = views.read(spark, sf_dir, "orders").select((key % 7).alias("document_id"), key.cast("double").alias("s"), (key + F.pow(F.lit(2.0), key % 19) / 8).alias("e"))
    b = views.read(spark, sf_dir, "customer").select((own % 7).alias("document_id"), own.alias("j"), (own * 4.0).alias("ts"), (own * 4 + F.pow(F.lit(2.0), own % 23) / 64).alias("te"))
    met = overlap_join(a, b, ["document_id"], ("s", "e"), ("ts", "te"), 4.0)
    return met.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.least("e", "te") - F.greatest("s", "ts")), 3).alias("shared"))
