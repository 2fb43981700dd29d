"""Registered queries: notes, tags, collections, evidence scopes, discovery, saved searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import incremental, lexical, research
from quillon.operators.lexical import SearchQuery
from quillon.plans import sql as S
from quillon.plans.search import joined
from quillon.sources import views

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


def _by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by user: a user's note has the tags, days and words of all its events."""
    return views.notes(spark, sf_dir).withColumn("note_id", F.col("document_id"))


_N = f"WITH n AS (SELECT * REPLACE (document_id AS note_id) FROM ({S.NOTES}))"
_TAGS = "SELECT note_id FROM n WHERE tag IN ('error', 'purchase', 'signup') GROUP BY note_id HAVING count(DISTINCT tag) = 3"
_DAYS = "SELECT note_id FROM n WHERE collection IN ('2024-01-02', '2024-01-09') GROUP BY note_id HAVING count(DISTINCT collection) = 2"
_WORDS = "SELECT note_id FROM n WHERE list_has_all({t}, ['click', 'k', '42'])".format(t=S.tokens("body"))


@query(f"{_N} {_TAGS}")
def notes_all_tags(spark, sf_dir):
    return research.matching_notes(_by_user(spark, sf_dir), tags=["error", "purchase", "signup"])


@query(f"{_N} SELECT DISTINCT note_id FROM ({_WORDS})")
def notes_all_terms(spark, sf_dir):
    return research.matching_notes(_by_user(spark, sf_dir), note_text="click k 42")


@query(f"{_N} SELECT DISTINCT note_id FROM n WHERE note_id IN ({_TAGS}) AND note_id IN ({_DAYS}) AND note_id IN ({_WORDS})")
def notes_combined(spark, sf_dir):
    return research.matching_notes(_by_user(spark, sf_dir), ["error", "purchase", "signup"], ["2024-01-02", "2024-01-09"], "click k 42")


@query(f"{_N} SELECT note_id FROM n WHERE false")
def notes_without_words(spark, sf_dir):
    """A note text without words matches nothing."""
    return research.matching_notes(_by_user(spark, sf_dir), note_text="--- !")


@query("SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3")
def orders_with_all_flags(spark, sf_dir):
    return research.having_all(views.read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


def _note_segments(spark, sf_dir) -> DataFrame:
    """Each event points at one segment of the document with its user's number."""
    return views.notes(spark, sf_dir).select("note_id", "document_id", F.format_string("segment-%06d", F.col("note_id") % 3).alias("segment_id"))


_NS = "ns AS (SELECT event_id AS note_id, user_id AS document_id, printf('segment-%06d', event_id % 3) AS segment_id FROM events)"


@query(f"WITH {_NS} SELECT DISTINCT document_id, segment_id FROM ns JOIN events e ON e.event_id = ns.note_id WHERE e.event_type = 'error'")
def matching_evidence(spark, sf_dir):
    return research.matching_evidence(research.matching_notes(views.notes(spark, sf_dir), tags=["error"]), _note_segments(spark, sf_dir))


def _summaries(spark, sf_dir) -> DataFrame:
    notes = views.notes(spark, sf_dir)
    return research.summaries(_note_segments(spark, sf_dir), notes.select("note_id", "tag"), notes.select("note_id", "collection"), ["document_id", "segment_id"])


_SUMMED = f"""WITH {_NS}, s AS (SELECT ns.document_id, segment_id, list_sort(list_distinct(list(note_id))) AS note_ids, list_sort(list_distinct(list(event_type))) AS tags,
  list_sort(list_distinct(list(strftime(ts, '%Y-%m-%d')))) AS collections FROM ns JOIN events e ON e.event_id = ns.note_id GROUP BY ALL)"""


@query(_SUMMED + " SELECT document_id, segment_id, array_to_string(note_ids, '|') AS note_ids, array_to_string(tags, '|') AS tags, array_to_string(collections, '|') AS collections FROM s")
def evidence_summaries(spark, sf_dir):
    return _summaries(spark, sf_dir).select("document_id", "segment_id", joined("note_ids"), joined("tags"), joined("collections"))


@query(_SUMMED + """ SELECT document_id AS passage_id, array_to_string(list_sort(list_distinct(flatten(list(note_ids)))), '|') AS note_ids,
  array_to_string(list_sort(list_distinct(flatten(list(tags)))), '|') AS tags FROM s GROUP BY document_id""")  # fmt: skip
def passage_research(spark, sf_dir):
    """Passages of three segments with the research on any of them."""
    rows = _summaries(spark, sf_dir)
    passages = rows.select(F.col("document_id").alias("passage_id"), "document_id", "segment_id")
    return research.union_views(rows, passages, ["document_id", "segment_id"]).select("passage_id", joined("note_ids"), joined("tags"))


@query("SELECT event_type AS tag, count(*) AS usage_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used_at FROM events GROUP BY 1 ORDER BY 2 DESC, max(ts) DESC, 1 LIMIT 3")
def navigation_frequent(spark, sf_dir):
    return _stamped(research.navigation(views.notes(spark, sf_dir), "tag", "updated_at", limit=3))


@query("SELECT strftime(ts, '%Y-%m-%d') AS collection, count(*) AS usage_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used_at FROM events GROUP BY 1 ORDER BY max(ts) DESC, 2 DESC, 1 LIMIT 10")
def navigation_recent(spark, sf_dir):
    return _stamped(research.navigation(views.notes(spark, sf_dir), "collection", "updated_at", by_recency=True, limit=10))


def _stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("last_used_at", F.date_format("last_used_at", "yyyy-MM-dd HH:mm:ss"))


_SQ = f"array_to_string({S.words(S.fold('p_name'))}, ' ')"
_COMMON = f"len(list_filter(['red', 'ring'], lambda t: list_contains({S.tokens('p_name')}, t)))"


@query(f"""SELECT p_partkey AS id, tier, overlap, normalized_name FROM (SELECT p_partkey, {_SQ} AS normalized_name,
  CASE WHEN {_SQ} = 'red ring' THEN 0 WHEN starts_with({_SQ}, 'red ring') THEN 1 WHEN contains({_SQ}, 'red ring') THEN 2 WHEN {_COMMON} > 0 THEN 3 END AS tier,
  CASE WHEN contains({_SQ}, 'red ring') THEN 0 ELSE -{_COMMON} END::INT AS overlap FROM part) WHERE tier IS NOT NULL ORDER BY tier, overlap, normalized_name, id LIMIT 100""")  # fmt: skip
def name_match_tiers(spark, sf_dir):
    dimension = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return research.name_matches(dimension, "id", "name", " Red  RING", 100).select("id", "tier", "overlap", "normalized_name")


@query(f"""WITH {S.bm25(S.SEGMENTS, ['error', 'the'])}, n AS (SELECT * REPLACE (document_id AS note_id) FROM ({S.NOTES}))
  SELECT * FROM (SELECT 'evidence' AS kind, document_id || ':' || segment_id AS id FROM sc JOIN seg USING (document_id, segment_id) ORDER BY score DESC, document_id, start_seconds, segment_id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'note', note_id::VARCHAR FROM (SELECT DISTINCT note_id FROM ({S.NOTES}) WHERE list_has_all({S.tokens('body')}, ['error', 'the'])) ORDER BY note_id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'tag', event_type FROM (SELECT DISTINCT event_type FROM events) WHERE event_type = 'error' ORDER BY 2 LIMIT 10)
  UNION ALL SELECT 'collection', '' WHERE false""")  # fmt: skip
def discover_grouped(spark, sf_dir):
    """Four typed groups, each ranked by itself; scores are never mixed."""
    from quillon.plans.workspace import Workspace

    notes = views.notes(spark, sf_dir)
    work = Workspace(views.segments(spark, sf_dir), notes=notes)
    groups = work.discover("error the", limit=10)
    rows = groups["evidence"].select(F.lit("evidence").alias("kind"), F.concat_ws(":", F.col("document_id").cast("string"), "segment_id").alias("id"))
    for kind, col in (("note", "note_id"), ("tag", "tag"), ("collection", "collection")):
        rows = rows.unionByName(groups[kind].select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("id")))
    return rows


@query("""SELECT e.event_id AS note_id, coalesce(d.doc_id IS NOT NULL AND CASE WHEN e.event_id % 4 = 0 THEN 'old' ELSE sha256(d.text) END = sha256(d.text), false) AS current
  FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id * 5""")  # fmt: skip
def note_currentness(spark, sf_dir):
    """Every fourth note is of an older generation; some documents are gone."""
    docs = views.documents(spark, sf_dir)
    notes = views.notes(spark, sf_dir).select("note_id", (F.col("document_id") * 5).alias("document_id"))
    anchored = notes.join(docs, "document_id", "left").select("note_id", "document_id", F.when(F.col("note_id") % 4 == 0, "old").otherwise(F.col("canonical_sha256")).alias("canonical_sha256"), "source_sha256")
    return research.with_currentness(anchored, docs).select("note_id", "current")


# ---- listings and lookups


@query("SELECT event_id AS note_id, user_id AS document_id FROM events ORDER BY ts DESC, event_id LIMIT 100")
def notes_listing(spark, sf_dir):
    return research.notes_listing(views.notes(spark, sf_dir), 100).select("note_id", "document_id")


@query("SELECT event_id AS note_id, user_id AS document_id FROM events WHERE event_type = 'signup' ORDER BY event_id LIMIT 100")
def notes_filtered_listing(spark, sf_dir):
    notes = views.notes(spark, sf_dir)
    return research.filtered_listing(notes, research.matching_notes(notes, tags=["signup"]), 100).select("note_id", "document_id")


@query("SELECT e.event_id AS note_id, r.ordinal::INT AS ordinal, e.event_type AS tag FROM events e JOIN (VALUES (0, 905), (1, 3), (2, 77), (3, 500), (4, 12)) r(ordinal, id) ON r.id = e.event_id ORDER BY ordinal")
def notes_by_ids(spark, sf_dir):
    return research.by_ids(views.notes(spark, sf_dir), [905, 3, 77, 500, 12, 10**12], "note_id").select("note_id", "ordinal", "tag")


@query("SELECT lower(tag) AS normalized_name, tag FROM (SELECT DISTINCT event_type AS tag FROM events) ORDER BY 1, 2")
def dimension_listing(spark, sf_dir):
    tags = views.notes(spark, sf_dir).select("tag").distinct()
    return tags.select(T.squeeze(F.col("tag")).alias("normalized_name"), "tag").orderBy("normalized_name", "tag")


@query("""SELECT asked, ids FROM (VALUES ('known', (SELECT string_agg(DISTINCT event_type, '|' ORDER BY event_type) FROM events WHERE event_type IN ('click', 'view'))), ('unknown', NULL)) t(asked, ids)""")
def resolve_names(spark, sf_dir):
    """All names or none: an unknown one leaves nothing."""
    tags = views.notes(spark, sf_dir).select(F.col("tag").alias("id"), "tag").distinct()
    rows = [(k, "|".join(ids) if (ids := research.resolve(tags, names, "id", "tag")) is not None else None) for k, names in (("known", ["View", " CLICK "]), ("unknown", ["view", "no such tag"]))]
    return spark.createDataFrame(rows, "asked string, ids string")


@query("SELECT event_type AS tag, count(DISTINCT user_id) AS documents, count(*) AS notes FROM events GROUP BY event_type")
def navigation_join(spark, sf_dir):
    notes = views.notes(spark, sf_dir)
    tags = notes.select("note_id", "tag")
    return tags.join(notes.select("note_id", "document_id"), "note_id").groupBy("tag").agg(F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("notes"))


@query("""SELECT substr(sha256(n), 1, 16) AS tag_id, min(t) AS tag, n AS normalized_name FROM (SELECT upper(event_type) AS t, lower(event_type) AS n FROM events UNION ALL SELECT event_type, lower(event_type) FROM events)
  WHERE n NOT IN ('click', 'view') GROUP BY n""")  # fmt: skip
def label_get_or_create(spark, sf_dir):
    """Tags that are not known yet, whatever their spelling."""
    notes = views.notes(spark, sf_dir)
    names = notes.select(F.upper("tag").alias("name")).unionByName(notes.select(F.col("tag").alias("name")))
    known = spark.createDataFrame([("Click",), (" VIEW ",)], "tag string")
    return research.get_or_create(known, names, "tag_id", "tag", "name")


# ---- saved searches: benchmark items as (id, name, text, documents they are limited to)


def _saved(spark, sf_dir) -> DataFrame:
    rows = views.read(spark, sf_dir, "benchmark")
    return rows.select(
        F.col("item_id").alias("saved_search_id"), F.format_string("Search %02d", "item_id").alias("name"), "text", F.array(F.col("item_id"), F.col("item_id") + 7).alias("document_ids"), (F.col("item_id") % 5).alias("updated_at")
    )


@query("SELECT item_id AS saved_search_id, printf('Search %02d', item_id) AS name FROM benchmark WHERE item_id = 7")
def saved_search_lookup(spark, sf_dir):
    """By exact id, else by name: two keys, both for item 7."""
    from quillon.plans.workspace import find_saved

    return find_saved(_saved(spark, sf_dir), " search 07 ").select("saved_search_id", "name")


@query("SELECT item_id AS saved_search_id, to_json([item_id, item_id + 7])::VARCHAR AS document_ids FROM benchmark ORDER BY item_id % 5 DESC, lower(printf('Search %02d', item_id)), item_id")
def saved_search_listing(spark, sf_dir):
    rows = _saved(spark, sf_dir).orderBy(F.desc("updated_at"), T.squeeze(F.col("name")), "saved_search_id")
    return rows.select("saved_search_id", F.to_json("document_ids").alias("document_ids"))


@query("SELECT item_id AS saved_search_id FROM benchmark WHERE list_contains([item_id, item_id + 7], 9)")
def affected_searches(spark, sf_dir):
    return _saved(spark, sf_dir).filter(F.array_contains("document_ids", F.lit(9).cast("long"))).select("saved_search_id")


_RUN = f"""WITH {S.bm25(S.SEGMENTS, ASKED.split())}"""


@query(f"""{_RUN} SELECT document_id, segment_id, score FROM sc JOIN seg USING (document_id, segment_id) WHERE language IN ('en', 'fr') ORDER BY score DESC, document_id, start_seconds, segment_id LIMIT 25""")
def saved_search_run(spark, sf_dir):
    """A stored intent is read back and resolved now."""
    from quillon.plans.workspace import intent_from_json, intent_to_json

    q = intent_from_json(intent_to_json(SearchQuery(ASKED, languages=("en", "fr"), limit=25)))
    hits = lexical.scored(views.segments(spark, sf_dir), q).withColumn("score", F.round("score", 6))
    return lexical.ordered(hits, q).select("document_id", "segment_id", "score")


@query(f"""{_RUN}, {_NS}, scope AS (SELECT DISTINCT ns.document_id, segment_id FROM ns JOIN events e ON e.event_id = ns.note_id WHERE e.event_type = 'error'),
  hits AS (SELECT document_id, segment_id, start_seconds, score FROM sc JOIN seg USING (document_id, segment_id) WHERE (document_id, segment_id) IN (SELECT (document_id, segment_id) FROM scope)
           ORDER BY score DESC, document_id, start_seconds, segment_id LIMIT 30)
  SELECT document_id, segment_id, score, (SELECT array_to_string(list_sort(list_distinct(list(event_type))), '|') FROM ns JOIN events e ON e.event_id = ns.note_id
    WHERE ns.document_id = hits.document_id AND ns.segment_id = hits.segment_id) AS tags FROM hits""")  # fmt: skip
def research_constrained_search(spark, sf_dir):
    """Search inside the evidence of notes tagged ``error``, decorated with all tags on each hit."""
    segments, notes = views.segments(spark, sf_dir, with_sha=True), views.notes(spark, sf_dir)
    keys = _note_segments(spark, sf_dir)
    marked = research.matching_evidence(research.matching_notes(notes, tags=["error"]), keys)
    scope = marked.join(views.documents(spark, sf_dir).select("document_id", "canonical_sha256"), "document_id")
    q = SearchQuery(ASKED, limit=30)
    hits = lexical.ordered(lexical.scored(segments, q, scope).withColumn("score", F.round("score", 6)), q)
    found = _summaries(spark, sf_dir)
    return hits.join(found, ["document_id", "segment_id"], "left").select("document_id", "segment_id", "score", joined("tags"))


# ---- change log


def _log(spark, sf_dir) -> DataFrame:
    """Events in time as changes of their user's note."""
    rows = views.read(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").alias("note_id"), "event_type")
    return incremental.with_sequence(rows, ["ts", "event_id"])


_LOG = "log AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS sequence_id, user_id AS note_id, event_type FROM events)"


@query(f"WITH {_LOG} SELECT sequence_id, note_id FROM log")
def journal_sequence(spark, sf_dir):
    return _log(spark, sf_dir).select("sequence_id", "note_id")


@query(f"WITH {_LOG} SELECT sequence_id, note_id FROM log WHERE sequence_id > 300 ORDER BY sequence_id LIMIT 500")
def changes_batch(spark, sf_dir):
    return incremental.batch_after(_log(spark, sf_dir), 300).select("sequence_id", "note_id")


@query(f"WITH {_LOG} SELECT max(sequence_id) AS current_sequence, 300::BIGINT AS projected_through, max(sequence_id) - 300 AS behind FROM log")
def projection_status(spark, sf_dir):
    return incremental.status(_log(spark, sf_dir), 300)


@query(f"WITH {_LOG} SELECT sequence_id, note_id FROM log WHERE sequence_id > (SELECT max(sequence_id) FROM log) - 2048")
def outbox_compaction(spark, sf_dir):
    log = _log(spark, sf_dir)
    last = log.agg(F.max("sequence_id")).first()[0] or 0
    return incremental.compacted(log, last).select("sequence_id", "note_id")


@query(f"""WITH {_LOG}, t AS (SELECT * FROM (VALUES (0, 'whole'), (300, 'whole'), (300, 'compacted'), (0, 'compacted'), (300, 'empty')) t(watermark, kept)),
  n AS (SELECT max(sequence_id) AS last FROM log)
  SELECT watermark, kept, CASE kept WHEN 'empty' THEN last > watermark WHEN 'whole' THEN 1 > watermark + 1 ELSE greatest(1, last - 99) > watermark + 1 END AND last > watermark AS gap FROM t, n""")  # fmt: skip
def outbox_gap(spark, sf_dir):
    """Whether a whole log, its last 100 changes, or none can serve a projection at some watermark."""
    log = _log(spark, sf_dir)
    last = log.agg(F.max("sequence_id")).first()[0] or 0
    logs = {"whole": log, "compacted": incremental.compacted(log, last, 100), "empty": log.limit(0)}
    cases = [(0, "whole"), (300, "whole"), (300, "compacted"), (0, "compacted"), (300, "empty")]
    return spark.createDataFrame([(w, kept, incremental.has_gap(logs[kept], w, last)) for w, kept in cases], "watermark int, kept string, gap boolean")


@query("""WITH u AS (SELECT doc_id FROM documents WHERE doc_id % 5 < 2 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 10 = 1),
  r AS (SELECT doc_id FROM documents WHERE doc_id % 5 = 3 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 15 = 3 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 20 = 0),
  c AS (SELECT doc_id, sum(u) AS u, sum(r) AS r FROM (SELECT doc_id, 1 AS u, 0 AS r FROM u UNION ALL SELECT doc_id, 0, 1 FROM r) GROUP BY doc_id)
  SELECT doc_id AS document_id, 'duplicate upsert' AS problem FROM c WHERE u > 1 UNION ALL SELECT doc_id, 'duplicate removal' FROM c WHERE r > 1 UNION ALL SELECT doc_id, 'both' FROM c WHERE u > 0 AND r > 0""")  # fmt: skip
def delta_rejects(spark, sf_dir):
    """What is wrong with a delta in which some documents are listed twice, and some in both lists."""
    docs, n = views.documents(spark, sf_dir).select("document_id"), F.col("document_id")
    upserted = docs.filter(n % 5 < 2).unionByName(docs.filter(n % 10 == 1))
    removed = docs.filter(n % 5 == 3).unionByName(docs.filter(n % 15 == 3)).unionByName(docs.filter(n % 20 == 0))
    return incremental.delta_problems(upserted, removed)


@query(f"""WITH {_LOG}, s AS (SELECT user_id AS note_id, count(*) AS n_events FROM events WHERE event_type <> 'view' GROUP BY user_id HAVING user_id % 7 <> 0),
  touched AS (SELECT DISTINCT note_id FROM log WHERE sequence_id > 100)
  SELECT note_id, n_events FROM s WHERE note_id IN (SELECT note_id FROM touched) UNION ALL SELECT note_id, -1 FROM (SELECT DISTINCT user_id AS note_id FROM events) WHERE note_id NOT IN (SELECT note_id FROM touched)""")  # fmt: skip
def outbox_replay(spark, sf_dir):
    """The final projection after all changes past 100: present state for touched notes, the old rows for the others."""
    log = _log(spark, sf_dir)
    events = views.read(spark, sf_dir, "events")
    old = events.select(F.col("user_id").alias("note_id")).distinct().withColumn("n_events", F.lit(-1).cast("long"))
    state = events.filter("event_type <> 'view'").groupBy(F.col("user_id").alias("note_id")).agg(F.count(F.lit(1)).alias("n_events")).filter("note_id % 7 <> 0")
    return incremental.apply_changes(old, log.filter("sequence_id > 100"), state)


@query("""SELECT user_id AS note_id, event_id AS anchor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS revision,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_current FROM events""")  # fmt: skip
def anchor_history(spark, sf_dir):
    from quillon.operators import evidence

    rows = views.read(spark, sf_dir, "events").select(F.col("user_id").alias("note_id"), F.col("event_id").alias("anchor"), "ts")
    return evidence.anchor_history(rows, "note_id", ["ts", "anchor"]).select("note_id", "anchor", "revision", "is_current")


@query("""SELECT path, strict FROM (SELECT doc_id % 400 AS path, bool_or(doc_id % 3 = 0) AS strict FROM documents GROUP BY 1)""")
def candidate_union(spark, sf_dir):
    """Candidates of two sources; the strict one wins."""
    rows = views.documents(spark, sf_dir).select((F.col("document_id") % 400).alias("path"), "document_id")
    strict = rows.filter("document_id % 3 = 0").select("path").distinct()
    return incremental.candidate_union(strict, rows.filter("document_id % 3 <> 0").select("path").distinct()).select("path", "strict")


_OLD = "SELECT doc_id AS document_id, sha256(text) AS c, doc_id % 2 AS m FROM documents WHERE doc_id % 10 <> 3"
_NEW = "SELECT doc_id AS document_id, CASE WHEN doc_id % 10 = 5 THEN sha256(text || 'x') ELSE sha256(text) END AS c, CASE WHEN doc_id % 10 = 6 THEN 9 ELSE doc_id % 2 END AS m FROM documents WHERE doc_id % 10 <> 4"


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.document_id, n.document_id) AS document_id,
  CASE WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' WHEN o.c = n.c AND o.m = n.m THEN 'unchanged' ELSE 'updated' END AS status, o.c IS DISTINCT FROM n.c AS semantic_dirty
  FROM o FULL JOIN n ON o.document_id = n.document_id""")  # fmt: skip
def refresh_delta(spark, sf_dir):
    """Two states of the library: some documents are new, gone, changed in content, or only touched."""
    docs, last = views.documents(spark, sf_dir), F.col("document_id") % 10
    old = docs.filter(last != 3).select("document_id", "canonical_sha256", (F.col("document_id") % 2).alias("modified_ns"))
    new = docs.filter(last != 4).select(
        "document_id", F.when(last == 5, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("canonical_sha256")).alias("canonical_sha256"),
        F.when(last == 6, 9).otherwise(F.col("document_id") % 2).cast("long").alias("modified_ns"),
    )
    return incremental.refresh_delta(old, new)


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), s AS (SELECT CASE WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' WHEN o.c = n.c AND o.m = n.m THEN 'unchanged' ELSE 'updated' END AS status,
  o.c IS DISTINCT FROM n.c AS dirty FROM o FULL JOIN n ON o.document_id = n.document_id) SELECT status, count(*) AS documents, bool_or(dirty) AS clears_vectors FROM s GROUP BY status""")  # fmt: skip
def refresh_report(spark, sf_dir):
    return QUERIES["refresh_delta"](spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.bool_or("semantic_dirty").alias("clears_vectors"))
