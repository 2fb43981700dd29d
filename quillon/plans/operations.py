"""Registered queries: windows, exports, custody plans, checks, timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import time as D
from quillon.operators import assembly, custody, export, validation
from quillon.plans import sql as S
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


_TR = f"tr AS ({S.TRANSCRIPTS})"

# ---- windows: each conversation is a recording at 100 frames a second, windows of 20 seconds


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = views.transcripts(spark, sf_dir).groupBy("document_id").agg(F.max("end_seconds").alias("e"))
    recordings = ends.select("document_id", F.floor(F.col("e") * 100).cast("long").alias("frames"), F.lit(100).cast("long").alias("sample_rate_hz"))
    return assembly.window_plan(recordings, 20)


_WIN = f"""{_TR}, rec AS (SELECT document_id, floor(max(end_seconds) * 100)::BIGINT AS frames FROM tr GROUP BY document_id),
  win AS (SELECT document_id, (s // 2000)::INT AS window_index, s AS start_frame, least(s + 2000, frames) AS end_frame, s / 100.0::DOUBLE AS start_seconds, least(s + 2000, frames) / 100.0::DOUBLE AS end_seconds
          FROM (SELECT document_id, frames, unnest(range(0, frames, 2000)) AS s FROM rec WHERE frames > 0))"""


@query(f"WITH {_WIN} SELECT document_id, window_index, printf('audio-%06d', window_index) AS window_id, start_frame, end_frame, 100::BIGINT AS sample_rate_hz, start_seconds, end_seconds FROM win")
def window_plan(spark, sf_dir):
    return _windows(spark, sf_dir)


def _results(windows: DataFrame) -> DataFrame:
    """Two results per window, the second up to its very end; languages by document."""
    length = F.col("end_seconds") - F.col("start_seconds")
    parts = F.array(F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("s"), (length / 2).alias("e")), F.struct(F.lit(1).alias("i"), (length / 2).alias("s"), (length + 0.01).alias("e")))
    rows = windows.select("document_id", "window_index", F.explode(parts).alias("p"))
    return rows.select(
        "document_id", "window_index", F.col("p.i").alias("local_index"), F.col("p.s").alias("start_seconds"), F.col("p.e").alias("end_seconds"), F.concat_ws("/", "window_index", "p.i").alias("text"),
        F.when(F.col("document_id") % 3 == 0, F.lit("en")).when(F.col("window_index") % 2 == 0, "fr").otherwise("de").alias("language"), (1.0 / (F.col("window_index") + 2)).alias("language_probability"),
    )


@query(f"""WITH {_WIN}, r AS (SELECT win.*, i, CASE i WHEN 0 THEN 0.0::DOUBLE ELSE (end_seconds - start_seconds) / 2 END AS ls, CASE i WHEN 0 THEN (end_seconds - start_seconds) / 2 ELSE end_seconds - start_seconds + 0.01::DOUBLE END AS le
    FROM win, (VALUES (0), (1)) t(i))
  SELECT document_id, window_index, printf('segment-%06d', row_number() OVER (PARTITION BY document_id ORDER BY window_index, i) - 1) AS segment_id, round(least(end_seconds, start_seconds + ls), 6) AS start_seconds,
    round(CASE WHEN le > end_seconds - start_seconds OR abs(le - (end_seconds - start_seconds)) <= 1e-9 THEN end_seconds ELSE start_seconds + le END, 6) AS end_seconds, window_index || '/' || i AS text FROM r""")  # fmt: skip
def assemble_rebase(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    rows = assembly.assemble(windows, _results(windows))
    return rows.select("document_id", "window_index", "segment_id", F.round("start_seconds", 6).alias("start_seconds"), F.round("end_seconds", 6).alias("end_seconds"), "text")


@query(f"""WITH {_WIN}, r AS (SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'en' WHEN window_index % 2 = 0 THEN 'fr' ELSE 'de' END AS l, 1.0::DOUBLE / (window_index + 2) AS p FROM win)
  SELECT document_id, CASE WHEN count(DISTINCT l) = 1 THEN min(l) END AS language, CASE WHEN count(DISTINCT l) = 1 THEN round(min(p), 9) END AS language_probability FROM r GROUP BY document_id""")  # fmt: skip
def assembly_summary(spark, sf_dir):
    return assembly.summary(_results(_windows(spark, sf_dir))).withColumn("language_probability", F.round("language_probability", 9))


@query(f"WITH {_WIN} SELECT document_id, window_index, CASE WHEN window_index = 1 THEN 'origin' ELSE 'index' END AS problem FROM win WHERE window_index > 0 AND window_index <> 1 UNION ALL SELECT document_id, 1, 'index' FROM win WHERE window_index = 1")
def window_violations(spark, sf_dir):
    """Windows whose first one is lost: every other one is out of place."""
    return assembly.window_violations(_windows(spark, sf_dir).filter("window_index > 0"))


@query(f"WITH {_WIN} SELECT document_id, least(2, count(*))::BIGINT AS complete FROM win GROUP BY document_id")
def checkpoint_prefix(spark, sf_dir):
    """What a restart may skip when the third window was lost."""
    return assembly.complete_prefix(_windows(spark, sf_dir).filter("window_index <> 2"))


# ---- exports

_CUE = f"""SELECT document_id, segment_index, segment_id, row_number() OVER (PARTITION BY document_id ORDER BY segment_index) AS n, start_seconds, end_seconds,
  '[' || speaker_ref || '] ' || array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)), lambda l: {S.strip('l')}), lambda l: l <> ''), ' ') AS body FROM tr"""


def _cue_sql(separator: str) -> str:
    start, end = S.clock(S.ms("start_seconds", "floor"), separator), S.clock(S.ms("end_seconds", "ceil"), separator)
    return f"WITH {_TR}, c AS ({_CUE}), t AS (SELECT *, {start} || ' --> ' || {end} AS line FROM c)"


@query(_cue_sql(",") + " SELECT document_id, string_agg(n || chr(10) || line || chr(10) || body, chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) AS content FROM t GROUP BY document_id")
def export_srt(spark, sf_dir):
    return export.srt(views.transcripts(spark, sf_dir))


@query(_cue_sql(".") + " SELECT document_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(segment_id || chr(10) || line || chr(10) || body, chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) AS content FROM t GROUP BY document_id")
def export_vtt(spark, sf_dir):
    return export.vtt(views.transcripts(spark, sf_dir))


@query(_cue_sql(".") + " SELECT document_id, string_agg(body, chr(10) ORDER BY n) || chr(10) AS content FROM t GROUP BY document_id")
def export_txt(spark, sf_dir):
    return export.txt(views.transcripts(spark, sf_dir))


@query(f"WITH {_TR} SELECT document_id, segment_id, {S.clock(S.ms('end_seconds', 'round'), '.')} AS elapsed, CASE WHEN end_seconds >= 3600 THEN printf('%d:%02d:%02d', (floor(end_seconds)::BIGINT // 3600), (floor(end_seconds)::BIGINT // 60) % 60, floor(end_seconds)::BIGINT % 60) ELSE printf('%d:%02d', (floor(end_seconds)::BIGINT // 60), floor(end_seconds)::BIGINT % 60) END AS short FROM tr")
def elapsed_format(spark, sf_dir):
    rows = views.transcripts(spark, sf_dir)
    return rows.select("document_id", "segment_id", D.elapsed(F.col("end_seconds")).alias("elapsed"), D.short_clock(F.col("end_seconds")).alias("short"))


@query("""WITH d AS (SELECT doc_id AS document_id, regexp_replace(text, '[^\\p{L}\\p{N} ._\\-()]', '_', 'g') AS c FROM documents)
  , e AS (SELECT document_id, c, CASE WHEN rtrim(c, ' .') = '' THEN '_' ELSE rtrim(c, ' .') END AS t FROM d)
  SELECT document_id, CASE WHEN c IN ('', '.', '..') THEN repeat('_', greatest(1, length(c))) WHEN regexp_matches(upper(regexp_replace(t, '^(.+)\\.[^.]*$', '\\1')), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || t ELSE t END AS file_name FROM e""")  # fmt: skip
def file_names(spark, sf_dir):
    """Artifact names from whole texts."""
    return views.documents(spark, sf_dir).select("document_id", T.file_name(F.col("text")).alias("file_name"))


# ---- custody: orders are jobs, their date the last update


def _jobs(spark, sf_dir) -> DataFrame:
    orders = views.read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return orders.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("updated_at"), F.concat(F.lit("jobs/"), F.col("o_orderkey").cast("string")).alias("workspace_path"))


def _candidates(spark, sf_dir) -> DataFrame:
    """The cutoff is the day half-way between the first and the last update."""
    jobs = _jobs(spark, sf_dir)
    first, last = jobs.agg(F.min(F.to_date("updated_at")), F.max(F.to_date("updated_at"))).first()
    cutoff = F.lit(str(first + (last - first) // 2)).cast("timestamp_ntz")
    return custody.retention_candidates(jobs, cutoff, include_incomplete=True)


_JOBS = """jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderdate AS updated_at FROM orders),
  cand AS (SELECT * FROM jobs WHERE status <> 'running' AND updated_at <= (SELECT min(updated_at)::DATE + ((max(updated_at)::DATE - min(updated_at)::DATE) // 2)::INT FROM jobs))"""


@query(f"WITH {_JOBS} SELECT job_id, status, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, status <> 'completed' AS resume_lost FROM cand ORDER BY cand.updated_at, job_id")
def retention_plan(spark, sf_dir):
    rows = _candidates(spark, sf_dir).orderBy("updated_at", "job_id")
    return rows.select("job_id", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "resume_lost")


@query(f"""WITH {_JOBS}, l AS (SELECT substr(sha256(job_id::VARCHAR), 1, 3) AS g, job_id || ':' || status || ':' || strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') || ':jobs/' || job_id AS l FROM cand),
  h AS (SELECT g, sha256(string_agg(l, chr(10) ORDER BY l)) AS h, count(*) AS n FROM l GROUP BY g)
  SELECT sum(n)::BIGINT AS candidates, 'retention:' || substr(sha256('retention-v1' || chr(10) || '30' || chr(10) || 'True' || chr(10) || string_agg(g || h, chr(10) ORDER BY g || h)), 1, 24) AS confirmation_token FROM h""")  # fmt: skip
def retention_token(spark, sf_dir):
    return custody.retention_token(_candidates(spark, sf_dir), 30, True)


_REQUESTED = ["canonical-transcript", "saved-searches"]


def _actions(spark, sf_dir, scopes: list[str]) -> tuple[DataFrame, DataFrame]:
    docs = views.documents(spark, sf_dir)
    notes = views.notes(spark, sf_dir).select("note_id", "document_id")
    saved = views.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("saved_search_id"), F.explode(F.array(F.col("item_id"), F.col("item_id") + 7)).alias("document_id"))
    return custody.deletion_actions(docs, notes, saved, scopes), docs


_LINES = """
  UNION ALL SELECT user_id, 'research-note', event_id::VARCHAR, 'preserved' FROM events WHERE user_id IN (SELECT doc_id FROM documents)
  UNION ALL SELECT document_id, 'saved-search', id, '{fate}' FROM (SELECT item_id::VARCHAR AS id, unnest([item_id, item_id + 7]) AS document_id FROM benchmark) WHERE document_id IN (SELECT doc_id FROM documents))"""
_ACTIONS = """a AS (
  SELECT doc_id AS document_id, unnest(['library-view', 'derived-artifacts', 'execution-state', 'canonical-transcript']) AS target, doc_id::VARCHAR AS object_id, 'action' AS fate FROM documents""" + _LINES.format(fate="action")
_VIEW_ACTIONS = "a AS (SELECT doc_id AS document_id, 'library-view' AS target, doc_id::VARCHAR AS object_id, 'action' AS fate FROM documents" + _LINES.format(fate="affected")


@query(f"WITH {_ACTIONS} SELECT document_id, target, object_id, fate FROM a")
def deletion_actions(spark, sf_dir):
    return _actions(spark, sf_dir, _REQUESTED)[0]


def _plan_sql(actions: str, scopes: list[str]) -> str:
    head = " || chr(10) || ".join(f"'{s}'" for s in scopes)
    return f"""WITH {actions}, l AS (SELECT *, fate || ':' || target || ':' || object_id AS l FROM a),
  g AS (SELECT document_id, substr(sha256(l), 1, 2) AS g, sha256(string_agg(l, chr(10) ORDER BY l)) AS h, count(*) FILTER (fate = 'action') AS a, count(*) FILTER (fate = 'preserved') AS p, count(*) FILTER (fate = 'affected') AS f FROM l GROUP BY ALL),
  p AS (SELECT document_id, string_agg(g || h, chr(10) ORDER BY g || h) AS l, sum(a)::BIGINT AS n_actions, sum(p)::BIGINT AS n_preserved, sum(f)::BIGINT AS n_affected FROM g GROUP BY document_id)
  SELECT p.document_id, n_actions, n_preserved, n_affected, 'delete:' || p.document_id || ':' || substr(sha256(text), 1, 12) || ':' || substr(sha256('delete-v1' || chr(10) || p.document_id || chr(10) || sha256(text) || chr(10)
    || {head} || chr(10) || l), 1, 16) AS confirmation_token FROM p JOIN documents ON doc_id = document_id"""


@query(_plan_sql(_ACTIONS, ["requested:canonical-transcript", "requested:saved-searches", "effective:library-view", "effective:derived-artifacts", "effective:execution-state", "effective:canonical-transcript", "effective:saved-searches"]))
def deletion_plan(spark, sf_dir):
    actions, docs = _actions(spark, sf_dir, _REQUESTED)
    return custody.deletion_plans(actions, docs, _REQUESTED)


@query(_plan_sql(_VIEW_ACTIONS, ["requested:library-view", "effective:library-view"]))
def deletion_plan_of_views(spark, sf_dir):
    """Only the views go; saved searches that name a document are affected."""
    actions, docs = _actions(spark, sf_dir, ["library-view"])
    return custody.deletion_plans(actions, docs, ["library-view"])


@query("SELECT l_shipdate::DATE::VARCHAR AS volume, sum(l_quantity)::DOUBLE AS required, min(l_extendedprice) AS free, sum(l_quantity) <= min(l_extendedprice) AS admitted FROM lineitem GROUP BY 1")
def volume_admission(spark, sf_dir):
    rows = views.read(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("volume"), F.col("l_quantity").alias("required"), F.col("l_extendedprice").alias("free"))
    return custody.volume_admission(rows)


@query("SELECT event_type AS stage, count(*) AS n, count(*) FILTER (value < 1) AS failed, round(sum(value), 4) AS total, max(value) AS longest FROM events GROUP BY event_type")
def stage_timings(spark, sf_dir):
    """Events as timed stages."""
    rows = views.read(spark, sf_dir, "events")
    return rows.groupBy(F.col("event_type").alias("stage")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 1).alias("failed"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("longest")
    )


# ---- checks


@query(f"""WITH {_TR}, b AS (SELECT document_id, segment_id, segment_index, text, start_seconds, CASE WHEN segment_index % 5 = 4 THEN start_seconds - 1 ELSE end_seconds END AS end_seconds FROM tr)
  SELECT document_id, segment_id, 'times' AS problem FROM b WHERE end_seconds < start_seconds UNION ALL SELECT document_id, segment_id, 'text' FROM b WHERE coalesce(trim(text), '') = ''""")  # fmt: skip
def invariant_violations(spark, sf_dir):
    """Segments of which every fifth ends before it starts."""
    rows = views.transcripts(spark, sf_dir)
    bad = rows.withColumn("end_seconds", F.when(F.col("segment_index") % 5 == 4, F.col("start_seconds") - 1).otherwise(F.col("end_seconds")))
    return validation.segment_violations(bad)


@query(f"""WITH {_TR}, t AS (SELECT document_id, speaker_ref, end_seconds + 2 AS e FROM tr WHERE speaker_ref <> 'system'), d AS (SELECT document_id, max(end_seconds) AS d FROM tr GROUP BY ALL)
  SELECT document_id, 'index' AS problem FROM tr GROUP BY document_id HAVING min(segment_index) <> 0 OR max(segment_index) + 1 <> count(DISTINCT segment_index)
  UNION ALL SELECT DISTINCT document_id, 'speaker' FROM tr WHERE (document_id, speaker_ref) NOT IN (SELECT (document_id, speaker_ref) FROM t)
  UNION ALL SELECT DISTINCT document_id, 'duration' FROM t JOIN d USING (document_id) WHERE e > d + 1e-6""")  # fmt: skip
def document_violations(spark, sf_dir):
    """Turns without those of the system, that run over the end."""
    rows = views.transcripts(spark, sf_dir)
    durations = rows.groupBy("document_id").agg(F.max("end_seconds").alias("duration_seconds"))
    return validation.document_violations(rows, views.turns(rows).filter("speaker_ref <> 'system'"), durations)


@query(f"""WITH {_TR}, words AS ({S.WORDS}), w AS (SELECT * REPLACE (CASE WHEN word_index % 9 = 8 THEN start_seconds - 0.25 ELSE start_seconds END AS start_seconds) FROM words),
  b AS (SELECT *, max(end_seconds) OVER (PARTITION BY document_id, segment_id ORDER BY word_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
  SELECT document_id, segment_id, word_index, 'backwards' AS problem FROM b WHERE start_seconds < before - 0.05::DOUBLE
  UNION ALL SELECT document_id, segment_id, word_index, 'outside' FROM b JOIN tr USING (document_id, segment_id) WHERE b.start_seconds < tr.start_seconds - 0.05::DOUBLE OR b.end_seconds > tr.end_seconds + 0.05::DOUBLE""")  # fmt: skip
def alignment_violations(spark, sf_dir):
    """Words of which every ninth starts too early."""
    rows = views.transcripts(spark, sf_dir)
    words = views.words(rows).withColumn("start_seconds", F.when(F.col("word_index") % 9 == 8, F.col("start_seconds") - 0.25).otherwise(F.col("start_seconds")))
    return validation.alignment_violations(words, rows)


@query(f"""WITH {_TR}, words AS ({S.WORDS}) SELECT DISTINCT document_id, segment_id FROM words WHERE word_index % 9 = 8""")
def speaker_violations(spark, sf_dir):
    """Segments with a speaker of which every ninth word has none."""
    rows = views.transcripts(spark, sf_dir)
    own = rows.select("document_id", "segment_id", F.col("speaker_ref").alias("_s"))
    words = views.words(rows).join(own, ["document_id", "segment_id"]).withColumn("speaker_ref", F.when(F.col("word_index") % 9 != 8, F.col("_s")))
    return validation.speaker_violations(words, rows)


@query("""WITH d AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 10 = 7 THEN NULL WHEN doc_id % 10 = 8 THEN ' ' ELSE lang END AS one, (doc_id % 4) / 2.0::DOUBLE AS p, CASE doc_id % 3 WHEN 0 THEN [lang] WHEN 1 THEN ['xx'] ELSE [lang, 'xx'] END AS l FROM documents)
  SELECT document_id, 'blank' AS problem FROM d WHERE trim(one) = '' UNION ALL SELECT document_id, 'probability' FROM d WHERE p > 1 UNION ALL SELECT document_id, 'mixed' FROM d WHERE len(l) > 1 AND one IS NOT NULL
  UNION ALL SELECT document_id, 'other' FROM d WHERE one <> l[1] UNION ALL SELECT document_id, 'alone' FROM d WHERE one IS NULL""")  # fmt: skip
def language_violations(spark, sf_dir):
    """Language summaries of which some do not fit what was found."""
    docs, n = views.read(spark, sf_dir, "documents"), F.col("doc_id")
    found = F.when(n % 3 == 0, F.array("lang")).when(n % 3 == 1, F.array(F.lit("xx"))).otherwise(F.array("lang", F.lit("xx")))
    one = F.when(n % 10 == 7, F.lit(None)).when(n % 10 == 8, " ").otherwise(F.col("lang"))
    return validation.language_violations(docs.select(n.alias("document_id"), one.alias("detected_language"), ((n % 4) / 2.0).alias("language_probability"), found.alias("detected_languages")))


@query(f"""WITH {_TR} SELECT c AS canonical_sha256, count(DISTINCT document_id) AS documents, sum(n)::BIGINT AS segments FROM (SELECT document_id, count(*) AS n, sha256(first(speaker_ref ORDER BY segment_index)) AS c FROM tr GROUP BY document_id) GROUP BY c""")
def documents_of_generation(spark, sf_dir):
    """Documents and segments of each generation (a digest of the first speaker)."""
    per = views.transcripts(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.min_by("speaker_ref", "segment_index"), 256).alias("canonical_sha256"))
    return per.groupBy("canonical_sha256").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("segments"))
