from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import lexical
from quillon.operators.lexical import SearchQuery
from quillon.sources import generations, term_index, views
from quillon.sources.term_index import TermIndex

SCHEMA = "document_id long, canonical_sha256 string, segment_id string, start_seconds double, text string, language string, speaker_ref string"
KEYS = ["document_id", "segment_id", "start_seconds", "matched_terms", "score"]


def segments(spark, ids, seed=1, per=40):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for d in ids:
        for k in range(per):
            text = " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(40)], k=r.randrange(0, 25)))
            rows.append((d, "g", f"segment-{k:06d}", 5.0 * k, text, r.choice(["en", "de", None]), r.choice(["s1", "s2", None])))
    return spark.createDataFrame(rows, SCHEMA)


def answer(df):
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*KEYS).collect()]


def same(index, rows, query, **more):
    wanted = lexical.ordered(lexical.scored(rows, query, more.get("scope")).withColumn("score", F.round("score", 6)), query)
    assert answer(index.search(query, places=6, **more)) == answer(wanted), query


QUERIES = [SearchQuery("w0 w1 w7", limit=10), SearchQuery("w3", limit=5), SearchQuery("w0 w39 w39", limit=1000), SearchQuery("w2 w5", all_terms=True, limit=30), SearchQuery("w0 w4", timeline=True, limit=7), SearchQuery("w1", languages=("de",), speaker_refs=("s1",), limit=20), SearchQuery("w1 w2", document_ids=(3, 5), limit=20), SearchQuery("nowhere", limit=5)]


@pytest.fixture
def index(spark, tmp_path):
    return TermIndex(spark, f"file://{tmp_path}/terms", shelves=4)


def test_answers_equal_the_scan(spark, index):
    rows = segments(spark, range(20)).cache()
    index.build(rows)
    for q in QUERIES:
        same(index, rows, q)
    same(index, rows, SearchQuery("w0 w1", phrase="w0 w1", limit=20), segments=rows)
    scope = rows.filter("document_id < 4").select(*lexical.SCOPE_KEYS)
    same(index, rows, SearchQuery("w0 w1", limit=20), segments=rows, scope=scope)


def test_postings_pass_one_exchange(spark):
    """A run is ranged once; its blocks hold each posting, of one term, within their bounds, and are full but for the last of a range or batch."""
    rows = segments(spark, range(12))
    made = term_index._run(term_index._found(rows), 1, 4)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1 and "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    blocks = made.collect()
    assert all(b["n"] == len(b["postings"]) <= term_index.BLOCK and b["most"] == max(p["tf"] for p in b["postings"]) and b["least"] == min(p["length"] for p in b["postings"]) for b in blocks)
    found = sorted((p["document_id"], p["segment_id"], b["term"], p["tf"]) for b in blocks for p in b["postings"])
    assert found == sorted(tuple(r) for r in lexical.terms(rows).select("document_id", "segment_id", "term", "term_frequency").collect())


def test_terms_are_counted_as_words_in_python(spark):
    """Several texts of one segment count as one; a few terms alone are those of the whole index."""
    rows = spark.createDataFrame([(1, "a", "x y x"), (1, "a", "y z"), (1, "b", ""), (2, "a", None), (2, "b", "X x")], "document_id long, segment_id string, text string")
    plan = lexical.terms(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # terms are made above the exchange
    asked = lambda df: sorted(tuple(r) for r in df.select("document_id", "segment_id", "term", "term_frequency").collect())
    assert asked(lexical.terms(rows)) == [(1, "a", "x", 2), (1, "a", "y", 2), (1, "a", "z", 1), (2, "b", "x", 2)]
    assert asked(lexical.terms(rows, ["x"])) == [(1, "a", "x", 2), (2, "b", "x", 2)]


def test_deltas_and_their_merge(spark, index):
    first, changed = segments(spark, range(12)), segments(spark, [2, 20], seed=9)
    index.build(first)
    index.apply(changed)
    held = generations.head(spark, index.root)
    now = first.filter("document_id <> 2").unionByName(changed)
    same(index, now, QUERIES[0])
    index.apply(removals=spark.createDataFrame([(5,), (77,)], "document_id long"))
    index.apply(changed.filter("document_id = 2"))  # once more the same
    now = now.filter("document_id <> 5")
    for q in QUERIES[:4]:
        same(index, now, q)
    runs = len(generations.head(spark, index.root).tables["postings"])
    index.merge()
    assert runs == 3 and len(generations.head(spark, index.root).tables["postings"]) == 1
    for q in QUERIES:
        same(index, now, q)
    assert answer(index.search(QUERIES[1], places=6, at=held)) == answer(lexical.ordered(lexical.scored(first.filter("document_id <> 2").unionByName(changed), QUERIES[1]).withColumn("score", F.round("score", 6)), QUERIES[1]))


def test_blocks_that_cannot_answer_are_left_out(spark, index, monkeypatch):
    rows = segments(spark, range(60), seed=4, per=100)
    index.build(rows)
    seen, plain = [], TermIndex._reachable

    def watched(self, blocks, *args):
        kept = plain(self, blocks, *args)
        seen.append((blocks.agg(F.sum("n")).first()[0], kept.agg(F.sum("n")).first()[0]))
        return kept

    monkeypatch.setattr(TermIndex, "_reachable", watched)
    for q in (SearchQuery("w0", limit=10), SearchQuery("w5 w30", limit=10), SearchQuery("w12", limit=3)):
        same(index, rows, q)
    one, two, other = seen
    assert one[1] < one[0] / 2 and other[1] < other[0] / 2 and two[1] <= two[0]  # of several terms each may add to the other's rows


def test_a_query_reads_a_small_part_of_the_index(spark, tmp_path):
    rows = views.segments(spark, "/root/testdata/sf0.1").withColumn("speaker_ref", F.lit(None).cast("string"))
    index = TermIndex(spark, f"file://{tmp_path}/terms", shelves=32)
    index.build(rows)
    size = sum(f.stat().st_size for f in (tmp_path / "terms").rglob("*.parquet"))
    heads = index._postings(generations.head(spark, index.root)).groupBy("term").agg(F.sum("n").alias("n"))
    term = heads.filter("n BETWEEN 20 AND 60 AND length(term) > 3").orderBy("term").first()["term"]
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    read = lambda: sum(x.totalInputBytes() for x in map(store.executorList(True).apply, range(store.executorList(True).size())))
    before = read()
    found = index._live(generations.head(spark, index.root), index._postings(generations.head(spark, index.root), [term])).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    assert 20 <= found <= 60
    assert 0 < read() - before < size / 100, (read() - before, size)
    same(index, rows, SearchQuery(term, limit=20))


def test_a_text_is_cut_once(spark, index):
    """Sizes, totals and postings, also the ranges of these, are of one pass over the segments."""
    made = spark.sparkContext.accumulator(0)

    def text(k):
        made.add(1)
        return f"w{k % 5} W{k % 3} it's"

    rows = spark.range(50).select((F.col("id") % 7).alias("document_id"), F.format_string("segment-%06d", "id").alias("segment_id"), F.col("id").cast("double").alias("start_seconds"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("speaker_ref"), F.udf(text, "string")("id").alias("text"))
    at = index.build(rows)
    assert made.value == 50 and index._totals(at) == (50, 150)
    assert sorted(tuple(r) for r in at.read(spark, "sizes").select("document_id", "segments", "tokens").collect()) == [(d, 8 if d == 0 else 7, 24 if d == 0 else 21) for d in range(7)]
    assert len(index.search(SearchQuery("it's", limit=100)).collect()) == 50


def test_tokens_cut_in_tasks_are_those_of_the_engine(spark):
    texts = ["", " ", "a", "'a'", "it's o’clock a''b a'’b c'd'e", "'", "ÄÖ ß ﬁ İ x²½ ٣ _a_ 中文'字", "a\nb\n", "\U0001d400'\U0001f600z", "é́ ée", "a\u0000b", "’’a’", "x'", None]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["a" + " ".join(points[k : k + 4096]) for k in range(0, len(points), 4096)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.fold(F.col("t")).alias("folded"), T.tokens(F.col("t")).alias("tokens")).orderBy("k").collect()
    text, tokens = T.cut_tokens([r["folded"] or "" for r in rows], np.frombuffer(T.token_letters(), np.uint8))
    found = [[] for _ in rows]
    for k, t in zip(text.tolist(), tokens.to_pylist(), strict=True):
        found[k].append(t)
    assert found == [r["tokens"] or [] for r in rows]


def test_bundles_of_any_size_make_blocks_of_all_postings(spark, monkeypatch):
    for name, value in (("HELD", 700), ("TEXT_BYTES", 500), ("BUNDLE", 9), ("BLOCK", 8)):
        monkeypatch.setattr(term_index, name, value)
    rows = segments(spark, range(6))
    schema = term_index.to_arrow_schema(term_index._bundle_schema(rows))
    batch = rows.select(*term_index._OWN, T.fold(F.col("text")).alias("folded")).toArrow().combine_chunks().to_batches()[0]
    packed = [r for b in term_index._count_batches([batch.slice(0, 0), batch.slice(0, 100), batch.slice(100)], T.token_letters(), 6, schema) for r in b.to_pylist()]
    own = [r for r in packed if r["shelf"] is None]
    assert sum(r["segments"] for r in own) == rows.count() and len(own) > 12
    again = list(term_index._pack_batches([pa.ipc.open_stream(r["body"]).read_all().combine_chunks().to_batches()[0] for r in packed if r["body"]], 6, schema))
    wanted = sorted(tuple(r) for r in lexical.terms(rows).select("document_id", "segment_id", "term", "term_frequency").collect())
    shelf = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in {w[2] for w in wanted}], "t string").select("t", term_index._shelf(F.col("t"), 6)).collect()}
    for some in ([r for r in packed if r["body"]], [r for b in again for r in b.to_pylist()]):
        assert max(r["n"] for r in some) <= 9 and len(some) > 100
        some.sort(key=lambda r: (r["shelf"], r["sheaf"], r["bundle"]))
        blocks = [x for b in term_index._blocks(iter([pa.RecordBatch.from_pylist(some[:50], schema), pa.RecordBatch.from_pylist(some[50:], schema)]), 3, [*term_index._OWN, "tf", "length"]) for x in b.to_pylist()]
        assert all(b["shelf"] == shelf[b["term"]] and b["n"] == len(b["postings"]) <= 8 and b["most"] == max(p["tf"] for p in b["postings"]) and b["least"] == min(p["length"] for p in b["postings"]) for b in blocks)
        assert sorted((p["document_id"], p["segment_id"], b["term"], p["tf"]) for b in blocks for p in b["postings"]) == wanted
        monkeypatch.setattr(term_index, "HELD", 1 << 20)
        whole = [x for b in term_index._blocks(iter([pa.RecordBatch.from_pylist(some, schema)]), 3, [*term_index._OWN, "tf", "length"]) for x in b.to_pylist()]
        places = [(b["term"], p["tf"], p["length"]) for b in whole for p in b["postings"]]
        assert sum(b["n"] < 8 for b in whole) <= len({b["term"] for b in whole}) and sum(b["n"] for b in whole) == len(wanted)
        for term in ("w0", "w3"):  # the most frequent first, then the shortest
            assert [(-f, n) for t, f, n in places if t == term] == sorted((-f, n) for t, f, n in places if t == term)
        monkeypatch.setattr(term_index, "HELD", 700)
