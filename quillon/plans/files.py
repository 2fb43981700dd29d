"""Registered queries: publication of exports, execution of deletion plans, measured stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import custody, export
from quillon.plans import operations
from quillon.sources import execution, generations, publication, shared, views
from quillon.streaming.measurements import Recorder, StreamRecorder, resource_summary, timings

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_CONTENT = "SELECT document_id, string_agg(body, chr(10) ORDER BY n) || chr(10) AS content FROM t GROUP BY document_id"


@query(operations._cue_sql(".") + f""", made AS ({_CONTENT}), k AS (SELECT *, 'talk ' || document_id % 100 AS stem, row_number() OVER (PARTITION BY document_id % 100 ORDER BY document_id) AS n FROM made),
  f AS (SELECT stem || CASE WHEN n = 1 THEN '' ELSE '-' || n END || '.txt' AS file_name, content FROM k)
  SELECT file_name, sha256(content) AS sha256, octet_length(encode(content)) AS n_bytes FROM f""")  # fmt: skip
def published_exports(spark, sf_dir):
    """The text of every conversation published in a folder, a hundred stems for all, and read back from there. One attempt before fails on a stale generation and leaves nothing."""
    contents = export.txt(views.transcripts(spark, sf_dir))
    files = contents.select(F.col("document_id").cast("long").alias("file_id"), F.concat(F.lit("talk "), (F.col("document_id") % 100).cast("string")).alias("stem"), F.lit("txt").alias("extension"), "content", "document_id", F.lit("now").alias("canonical_sha256"))
    folder = shared.folder(spark, "exports")
    path, there = generations._path(spark, folder)
    there.mkdirs(path)
    try:
        publication.publish(spark, files, folder, files.select("document_id", F.lit("then").alias("canonical_sha256")))
    except publication.Stale:
        pass
    publication.publish(spark, files, folder, files.select("document_id", "canonical_sha256"), last=None)
    return publication.contents(spark, folder).select("file_name", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n_bytes"))


@query("""WITH gone AS (SELECT doc_id FROM documents WHERE source LIKE '%1'), notes AS (SELECT event_id, user_id FROM events),
  here AS (SELECT * FROM notes WHERE user_id IN (SELECT doc_id FROM gone))
  SELECT 'documents' AS kind, doc_id::VARCHAR AS object_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
  UNION ALL SELECT 'notes', event_id::VARCHAR FROM notes WHERE user_id IS NULL OR user_id NOT IN (SELECT doc_id FROM gone)
  UNION ALL SELECT 'done: research-note', event_id::VARCHAR FROM here
  UNION ALL SELECT 'done: ' || s, doc_id::VARCHAR FROM gone, (VALUES ('library-view'), ('derived-artifacts'), ('execution-state'), ('canonical-transcript')) t(s)
  UNION ALL SELECT 'refused', '1'""")  # fmt: skip
def executed_deletion(spark, sf_dir):
    """The documents of every tenth source or so go with their notes: what is left, what the receipt says, and how often a token was refused that a new note has made stale."""
    root, log = shared.folder(spark, "state"), shared.folder(spark, "deletions")
    notes = views.notes(spark, sf_dir).select("note_id", "document_id")
    chosen = views.read(spark, sf_dir, "documents").filter("source LIKE '%1'").select(F.col("doc_id").alias("_id")).distinct()
    docs = views.documents(spark, sf_dir).select("document_id", "canonical_sha256")
    late = notes.filter("false") if chosen.isEmpty() else chosen.limit(1).select(F.lit(-1).cast(notes.schema["note_id"].dataType).alias("note_id"), F.col("_id").alias("document_id"))
    generations.commit(spark, root, None, 0, replace={"documents": docs, "notes": notes.unionByName(late)})
    scopes = ["canonical-transcript", "research-notes"]

    def plan():
        own = generations.read(spark, root, "documents").join(chosen, F.col("document_id") == F.col("_id"), "left_semi")
        saved = spark.createDataFrame([], "saved_search_id string, document_id long")
        actions = custody.deletion_actions(own, generations.read(spark, root, "notes"), saved, scopes)
        return actions.filter("fate = 'action'"), custody.batch_token(custody.deletion_plans(actions, own, scopes)).first()["confirmation_token"]

    tables = {"canonical-transcript": [("documents", "document_id")], "research-note": [("notes", "note_id")]}
    stale, refused = plan()[1], 0
    generations.commit(spark, root, generations.head(spark, root), 1, replace={"notes": notes})
    try:
        execution.execute(spark, log, stale, plan, root, tables)
    except execution.Refused:
        refused = 1
    done = execution.execute(spark, log, plan()[1], plan, root, tables)
    left = [generations.read(spark, root, name).select(F.lit(name).alias("kind"), F.col(key).cast("string").alias("object_id")) for name, key in (("documents", "document_id"), ("notes", "note_id"))]
    out = left[0].unionByName(left[1]).unionByName(done.select(F.concat(F.lit("done: "), "target").alias("kind"), "object_id"))
    return out.unionByName(spark.range(1).select(F.lit("refused").alias("kind"), F.lit(str(refused)).alias("object_id")))


@query(f"""WITH {operations._TR}, words AS (SELECT document_id, unnest(regexp_extract_all(text, '[^ ]+')) AS w FROM tr)
  SELECT 'segments' AS stage, 0::BIGINT AS failed, count(*) AS rows, round(sum(end_seconds - start_seconds), 4) AS media_seconds FROM tr
  UNION ALL SELECT 'words', 0, count(*), NULL FROM words UNION ALL SELECT 'words again', 1, 0, NULL UNION ALL SELECT 'documents', 0, count(*), NULL FROM documents""")  # fmt: skip
def observed_stages(spark, sf_dir):
    """Three stages over all segments, of which one fails, and a stream of all documents, as their recorders tell them."""
    recorder = Recorder(spark, shared.folder(spark, "measurements"))
    rows = views.transcripts(spark, sf_dir)
    write = lambda df: df.write.format("noop").mode("overwrite").save()
    with recorder.stage("segments") as span:
        span.run(rows, write, F.col("end_seconds") - F.col("start_seconds"))
    words = rows.select(F.explode(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))).alias("w"))
    with recorder.stage("words") as span:
        span.run(words, write)
    try:
        with recorder.stage("words again") as span:
            span.run(words, lambda df: df.write.format("noop").mode("no such mode").save())
    except Exception:  # the failure is what is measured
        pass
    listener = StreamRecorder(recorder)
    spark.streams.addListener(listener)
    try:
        schema = views.read(spark, sf_dir, "documents").schema  # the stream wants a pattern where the table is one file
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]").writeStream.queryName("documents").format("noop").trigger(availableNow=True)
        run = stream.option("checkpointLocation", shared.folder(spark, "stream")).start()
        run.awaitTermination()
        listener.wait(run)
    finally:
        spark.streams.removeListener(listener)
    return timings(recorder.table()).select("stage", "failed", "rows", F.round("media_seconds", 4).alias("media_seconds"))


@query("""SELECT count(*) AS samples, arg_min(event_id * 1000 + user_id, event_id) AS baseline_rss_bytes, max(event_id * 1000 + user_id) AS peak_rss_bytes, round(avg(event_id * 1000 + user_id), 4) AS mean_rss_bytes,
    max(value)::DOUBLE AS peak_cpu_percent, round(avg(value), 6) AS mean_cpu_percent, round(max(event_id * 1000 + user_id) / 1000000.0::DOUBLE, 6) AS peak_to_estimate FROM events""")  # fmt: skip
def resource_samples(spark, sf_dir):
    """Events as samples of a process tree, against an estimate of a million bytes."""
    rows = views.read(spark, sf_dir, "events")
    samples = rows.select(F.col("event_id").alias("sampled_at"), (F.col("event_id") * 1000 + F.col("user_id")).alias("rss_bytes"), F.col("value").cast("double").alias("cpu_percent"))
    out = resource_summary(samples, F.lit(1_000_000))
    return out.withColumns({"mean_rss_bytes": F.round("mean_rss_bytes", 4), "mean_cpu_percent": F.round("mean_cpu_percent", 6), "peak_to_estimate": F.round("peak_to_estimate", 6)})
