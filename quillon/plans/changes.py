"""Registered queries: writes of research state, labels, names, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators import changes, checkpoints
from quillon.plans.notebook import REQUEST, Notebook
from quillon.sources import canonical, generations, guarded, shared, views

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query("""WITH s AS (SELECT c_custkey AS record_id, 1 + c_custkey % 3 AS v FROM customer),
  c AS (SELECT CASE WHEN o_custkey % 7 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS record_id, min(o_orderkey) AS sequence_id FROM orders GROUP BY 1),
  d AS (SELECT *, ['create', 'update', 'delete', 'update', 'rename'][1 + sequence_id % 5] AS op, 1 + sequence_id % 3 AS expected FROM c),
  o AS (SELECT d.*, v, CASE WHEN op = 'rename' THEN 'invalid' WHEN op = 'create' AND v IS NOT NULL THEN 'exists' WHEN op <> 'create' AND v IS NULL THEN 'missing' WHEN op <> 'create' AND expected <> v THEN 'conflict' ELSE 'applied' END AS outcome
        FROM d LEFT JOIN s USING (record_id))
  SELECT record_id, sequence_id, op, outcome, CASE WHEN outcome <> 'applied' THEN v WHEN op = 'create' THEN 1 WHEN op = 'update' THEN v + 1 END::BIGINT AS version FROM o""")  # fmt: skip
def versioned_changes(spark, sf_dir):
    """One change for each of some records: creates, updates and deletes with the version they expect."""
    state = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), (1 + F.col("c_custkey") % 3).alias("version"))
    key = F.when(F.col("o_custkey") % 7 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey"))
    asked = views.read(spark, sf_dir, "orders").groupBy(key.alias("record_id")).agg(F.min("o_orderkey").alias("sequence_id"))
    names = F.array(*[F.lit(x) for x in ("create", "update", "delete", "update", "rename")])
    asked = asked.withColumn("op", F.get(names, (F.col("sequence_id") % 5).cast("int"))).withColumn("expected_version", 1 + F.col("sequence_id") % 3)
    return changes.outcomes(state, asked, "record_id").select("record_id", "sequence_id", "op", "outcome", "version")


@query("""WITH r AS (SELECT conv_id AS document_id, role AS speaker_ref, turn, CASE turn % 3 WHEN 1 THEN 'Person ' || turn WHEN 2 THEN repeat('y', 201) END AS label FROM conversations),
  v AS (SELECT * FROM r WHERE label IS NULL OR length(label) <= 200), l AS (SELECT document_id, speaker_ref, arg_max(coalesce(label, ''), turn) AS label FROM v GROUP BY ALL),
  old AS (SELECT DISTINCT conv_id AS document_id, role AS speaker_ref FROM conversations WHERE conv_id % 2 = 0)
  SELECT document_id, speaker_ref, label FROM l WHERE label <> '' UNION ALL SELECT document_id, speaker_ref, 'Old' FROM old WHERE (document_id, speaker_ref) NOT IN (SELECT (document_id, speaker_ref) FROM l)""")  # fmt: skip
def label_changes(spark, sf_dir):
    """Labels after requests that set, remove, or give one that is too long."""
    rows = views.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.lit("g").alias("canonical_sha256"), F.col("role").alias("speaker_ref"), F.col("turn").alias("sequence_id"))
    old = rows.filter("document_id % 2 = 0").select("document_id", "canonical_sha256", "speaker_ref").distinct().withColumn("label", F.lit("Old"))
    kind = F.col("sequence_id") % 3
    asked = rows.withColumn("label", F.when(kind == 1, F.concat(F.lit("Person "), F.col("sequence_id").cast("string"))).when(kind == 2, F.repeat(F.lit("y"), F.lit(201))))
    return changes.set_labels(old, asked)[0].select("document_id", "speaker_ref", "label")


@query("""WITH n AS (SELECT doc_id AS file_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL), k AS (SELECT *, n + (n >= 3)::INT AS k FROM n)
  SELECT file_id, CASE WHEN k = 1 THEN source || '.txt' WHEN k <= 1000 THEN source || '-' || k || '.txt' END AS file_name FROM k""")  # fmt: skip
def export_names(spark, sf_dir):
    """Names for one export per document, named by source, where the third name of each is taken."""
    docs = views.read(spark, sf_dir, "documents").filter("source IS NOT NULL")
    wanted = docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("stem"), F.lit("txt").alias("extension"))
    taken = docs.select(F.concat("source", F.lit("-3.TXT")).alias("file_name")).distinct()
    return changes.free_names(wanted, taken).select("file_id", "file_name")


@query("""SELECT doc_id AS document_id, CASE doc_id % 10 WHEN 4 THEN 'missing' WHEN 5 THEN 'changed' WHEN 6 THEN 'unreadable' WHEN 7 THEN 'unreadable' ELSE 'matches' END AS integrity FROM documents""")
def source_integrity(spark, sf_dir):
    """Sources of which some are gone, changed, unreadable, or changed while they were read."""
    docs, last = views.documents(spark, sf_dir), F.col("document_id") % 10
    index = docs.select("document_id", F.col("document_id").cast("string").alias("source_path"), F.col("canonical_sha256").alias("source_sha256"))
    digest = F.when(last == 5, F.sha2(F.concat("text", F.lit("x")), 256)).when(last != 6, F.col("canonical_sha256"))
    listing = docs.filter(last != 4).select(
        F.col("document_id").cast("string").alias("path"), digest.alias("sha256"), F.lit(1).alias("size_before"), F.when(last == 7, 2).otherwise(1).alias("size_after"), F.lit(1).alias("modified_before"), F.lit(1).alias("modified_after")
    )
    return canonical.source_integrity(index, listing).select("document_id", "integrity")


def _requests(spark, sf_dir, who, body=None):
    """A note to be made for every event; of two segments and its type as tag."""
    rows = views.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("note_id"), F.col("user_id").cast("string").alias("document_id"), F.lit("g").alias("canonical_sha256"), (F.lit(who) if body is None else body).alias("body"),
        F.array(F.concat(F.lit("segment-"), F.col("event_id").cast("string")), F.lit("segment-x")).alias("segment_ids"), F.array(F.col("event_type"), F.col("event_type")).alias("tags"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("even"))).alias("collections"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"),
    )
    return rows.select(*[f.split()[0] for f in REQUEST.split(", ")])


@query("""WITH r AS (SELECT event_id AS note_id, event_id % 11 = 0 AS bad FROM events), a AS (SELECT note_id, row_number() OVER (ORDER BY note_id) AS sequence_id FROM r WHERE NOT bad AND note_id % 3 = 0),
  b AS (SELECT note_id, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY note_id) AS sequence_id FROM r WHERE NOT bad AND note_id % 3 <> 0),
  asked AS (SELECT note_id, bad, false AS again FROM r UNION ALL SELECT note_id, bad, true FROM r WHERE note_id % 5 = 0)
  SELECT note_id, again, CASE WHEN bad THEN 'invalid' WHEN note_id % 3 = 0 THEN 'exists' WHEN again THEN 'repeated' ELSE 'created' END AS outcome,
    CASE WHEN NOT bad THEN coalesce(a.sequence_id, b.sequence_id) END AS sequence_id, CASE WHEN NOT bad THEN 2 ELSE 0 END::BIGINT AS segments, CASE WHEN NOT bad THEN 1 ELSE 0 END::BIGINT AS tags, CASE WHEN NOT bad AND note_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS collections
  FROM asked LEFT JOIN a USING (note_id) LEFT JOIN b USING (note_id)""")  # fmt: skip
def note_batches(spark, sf_dir):
    """Two batches of new notes, the second with notes that exist, are asked for twice or are blank; what the snapshot after them holds of each."""
    book = Notebook(spark, shared.folder(spark, "notebook"))
    rows = _requests(spark, sf_dir, "", F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("about "), "event_type")))
    book.create(rows.filter("note_id % 3 = 0"))
    asked = rows.withColumn("again", F.lit(False)).unionByName(rows.filter("note_id % 5 = 0").withColumns({"updated_at": F.col("updated_at") + 1, "again": F.lit(True)}))
    done = book.create(asked)
    now = book.snapshot().tables
    counts, parts = {"note_segments": "segments", "note_tags": "tags", "note_collections": "collections"}, now["journal"].select("note_id", "sequence_id")
    for table in counts:  # one grouping of what all tables hold of a note
        parts = parts.unionByName(now[table].select("note_id", F.lit(1).alias(counts[table])), allowMissingColumns=True)
    held = parts.groupBy("note_id").agg(F.max("sequence_id").alias("sequence_id"), *[F.sum(c).alias(c) for c in counts.values()])
    return done.select("note_id", "again", "outcome").join(held, "note_id", "left").fillna(0, list(counts.values()))


@query("""WITH a AS (SELECT event_id AS note_id FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0), b AS (SELECT event_id AS note_id FROM events WHERE event_id % 2 = 1)
  SELECT note_id, 'first' AS writer, row_number() OVER (ORDER BY note_id) AS sequence_id, 1 AS commit_number FROM a
  UNION ALL SELECT note_id, 'second', (SELECT count(*) FROM a) + row_number() OVER (ORDER BY note_id), 2 FROM b WHERE note_id NOT IN (SELECT note_id FROM a)""")
def commit_conflicts(spark, sf_dir):
    """Two writers prepare a batch on one state. The first commits; the second is refused, looks again and adds only what is still missing."""
    book = Notebook(spark, shared.folder(spark, "notebook"))
    first, second = _requests(spark, sf_dir, "first").filter("note_id % 2 = 0 OR note_id % 3 = 0"), _requests(spark, sf_dir, "second").filter("note_id % 2 = 1")
    base = generations.head(spark, book.root)
    generations.commit(spark, book.root, base, **book.prepare(first, base))
    number = 1
    try:
        generations.commit(spark, book.root, base, **book.prepare(second, base))
    except generations.Conflict:
        book.create(second)
        number = generations.head(spark, book.root).number
    now = book.snapshot().tables
    return now["journal"].join(now["notes"], "note_id").select("note_id", F.col("body").alias("writer"), "sequence_id", F.when(F.col("body") == "first", 1).otherwise(number).alias("commit_number"))


def _source_files(spark, rows, folder):
    """A file for each source with its texts in order, a line end after each."""
    parts = rows.repartition("source").sortWithinPartitions("source", "doc_id")
    made = f"{folder}-parts"
    parts.select("text", "source").write.mode("overwrite").partitionBy("source").text(made)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    for entry in files.listStatus(path(made)):
        name = entry.getPath().getName()
        if name.startswith("source="):  # one file for each source
            part = next(x.getPath() for x in files.listStatus(entry.getPath()) if x.getPath().getName().startswith("part-"))
            target = path(f"{folder}/{name[7:]}.txt")
            files.delete(target, False)
            files.rename(part, target)
    return files


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'none') AS source FROM documents), f AS (SELECT source, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS old, string_agg(text || 'x', chr(10) ORDER BY doc_id) || chr(10) AS new FROM d GROUP BY source)
  SELECT source, CASE WHEN source LIKE '%1' THEN 'changed' WHEN source LIKE '%3' THEN 'missing' ELSE 'matches' END AS integrity, CASE WHEN source LIKE '%1' THEN sha256(new) WHEN source LIKE '%3' THEN NULL ELSE sha256(old) END AS sha256,
    count(*) FILTER (source LIKE '%1') OVER ()::BIGINT AS updated, count(*) FILTER (source LIKE '%3') OVER ()::BIGINT AS removed, 0::BIGINT AS added FROM f""")  # fmt: skip
def guarded_refresh(spark, sf_dir):
    """The texts of each source as a file; some files change and some go between two runs of a refreshing stream, the second of which reads those only."""
    docs = views.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("none")).alias("source"))
    folder, root = shared.folder(spark, "sources"), shared.folder(spark, "files")
    files = _source_files(spark, docs, folder)
    guarded.refresh(spark, folder, root, f"{root}-checkpoint", ".txt")
    before = generations.read(spark, root, "files")
    _source_files(spark, docs.filter("source LIKE '%1'").withColumn("text", F.concat("text", F.lit("x"))), folder)
    for row in docs.filter("source LIKE '%3'").select("source").distinct().collect():  # a file for each source
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['source']}.txt"), False)
    told = (guarded.refresh(spark, folder, root, f"{root}-checkpoint", ".txt") or [{}])[-1]
    index = before.select(F.col("path").alias("document_id"), F.col("path").alias("source_path"), F.col("sha256").alias("source_sha256"))
    now = generations.read(spark, root, "files").select("path", "sha256")
    out = guarded.integrity(index, now.withColumn("problem", F.lit(None).cast("string"))).join(now.withColumnRenamed("path", "source_path"), "source_path", "left")
    name = F.regexp_extract("source_path", "([^/]+)[.]txt$", 1)
    return out.select(name.alias("source"), "integrity", "sha256", *[F.lit(told.get(k, 0)).cast("long").alias(k) for k in ("updated", "removed", "added")])


@query("""WITH RECURSIVE w AS (SELECT conv_id AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, sha256('{"model":"m","window":' || conv_id % 3 || '}') AS c, sha256(coalesce(text, '')) AS p FROM conversations),
  ch AS (SELECT document_id, k, c, sha256(c || chr(0) || k || chr(0) || p || chr(0)) AS h FROM w WHERE k = 0
    UNION ALL SELECT w.document_id, w.k, w.c, sha256(w.c || chr(0) || w.k || chr(0) || w.p || chr(0) || ch.h) FROM ch JOIN w ON w.document_id = ch.document_id AND w.k = ch.k + 1)
  SELECT document_id, k AS window_index, h AS chain_sha256 FROM ch""")  # fmt: skip
def sealed_windows(spark, sf_dir):
    """Every turn as a window's result, sealed to its contract and to those before it."""
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = views.read(spark, sf_dir, "conversations").withColumns({"window_index": F.row_number().over(order) - 1, "model": F.lit("m"), "window": F.col("conv_id") % 3})
    rows = rows.select(F.col("conv_id").alias("document_id"), "window_index", checkpoints.contract_digest("window", "model").alias("contract_sha256"), F.col("text").alias("payload"))
    return checkpoints.sealed(rows).select("document_id", F.col("window_index").cast("long").alias("window_index"), "chain_sha256")
