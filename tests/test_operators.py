"""Operators against hand-made cases."""

from __future__ import annotations

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import time as D
from quillon.functions import vectors as V
from quillon.operators import assembly, custody, evidence, export, fusion, incremental, language, lexical, research, semantic, speakers, validation
from quillon.operators.intervals import overlap_join
from quillon.operators.lexical import SearchQuery
from quillon.plans.workspace import Workspace, find_saved, hashed_vectors, intent_from_json, intent_to_json
from quillon.sources import canonical, generations
from quillon.streaming import outbox

SEGMENT = "document_id string, segment_index int, segment_id string, text string, language string, speaker_ref string, start_seconds double, end_seconds double, canonical_sha256 string"


def segments(spark, rows):
    """rows: (document, index, text, language, speaker)"""
    return spark.createDataFrame([(d, i, f"segment-{i:06d}", t, lang, who, 5.0 * i, 5.0 * i + 5, f"sha-{d}") for d, i, t, lang, who in rows], SEGMENT)


def column(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize("text", ["Straße İstanbul ΣΊΣΥΦΟΣ", "ﬁne ŉ ǰ ẞ", "É l’été O'Brien", "", "ᾳ ΐ Ꭰꭰ", "plain"])
def test_fold_is_python_casefold(spark, text):
    assert column(spark, text).select(T.fold(F.col("x"))).first()[0] == text.casefold()


def test_tokens(spark):
    got = column(spark, "Der Fluß, 3rd QUAY -- d'où? x_1’s").select(T.tokens(F.col("x"))).first()[0]
    assert got == ["der", "fluss", "3rd", "quay", "d'où", "x_1’s"]
    assert column(spark, None).select(T.tokens(F.col("x"))).first()[0] is None


def test_white_space_is_what_python_calls_so(spark):
    """Words and trimming by sets of characters (a class of all of them is matched many times slower)."""
    assert T.SPACES == "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    text = T.SPACES + "a" + "b".join(T.SPACES) + "\u200bé\U0001f600" + T.SPACES
    row = column(spark, text).select(T.strip(F.col("x")), T.lstrip(F.col("x")), T.words(F.col("x")), T.word_count(F.col("x"))).first()
    assert list(row) == [text.strip(), text.lstrip(), text.split(), len(text.split())]


def test_words_strip_and_names(spark):
    row = column(spark, "  two  words \n").select(T.strip(F.col("x")), T.words(F.col("x")), T.word_count(F.lit(" "))).first()
    assert tuple(row) == ("two  words", ["two", "words"], 1)
    tier = lambda name, q: column(spark, name).select(T.name_tier(F.col("x"), q)).first()[0]
    assert tuple(tier("Red  Ring", "red ring")) == (0, 0)
    assert tuple(tier("red ring two", "Red")) == (1, 0)
    assert tuple(tier("a red ring", "red r")) == (2, 0)
    assert tuple(tier("ring red", "red ring x")) == (3, -2)
    assert tier("blue", "red") is None


@pytest.mark.parametrize(("name", "expected"), [("a/b:c", "a_b_c"), ("..", "__"), ("", "_"), (" . ", "_"), ("con.txt", "_con.txt"), ("naïve ok. ", "naïve ok")])
def test_file_name(spark, name, expected):
    assert column(spark, name).select(T.file_name(F.col("x"))).first()[0] == expected


def test_cue_text(spark):
    assert column(spark, " a \r\n\r b \n").select(T.cue_text(F.col("x"))).first()[0] == "a b"
    with pytest.raises(Exception, match="cannot be exported"):
        column(spark, " \n ").select(T.cue_text(F.col("x"))).collect()


@pytest.mark.parametrize(("seconds", "elapsed", "start", "end"), [(83.456, "00:01:23.456", "00:01:23,456", "00:01:23,456"), (0.0005, "00:00:00.001", "00:00:00,000", "00:00:00,001"), (360000.25, "100:00:00.250",) * 1 + ("100:00:00,250",) * 2])
def test_times(spark, seconds, elapsed, start, end):
    row = column(spark, seconds, "double").select(D.elapsed(F.col("x")), D.cue_time(F.col("x"), ","), D.cue_time(F.col("x"), ",", True)).first()
    assert tuple(row) == (elapsed, start, end)


def test_vector_checks(spark):
    rows = spark.createDataFrame([([1.0, 0.0],), ([1.0],), ([float("nan"), 0.0],), ([0.6, 0.8],), ([0.6, 0.9],), (None,)], "v array<double>")
    assert [r[0] for r in rows.select(V.is_valid(F.col("v"), 2)).collect()] == [True, False, False, True, False, False]


# ---- lexical search

PORT = [
    ("m", 0, "A lantern hangs over the quiet pier, and the pier is empty", "en", "s1"), ("m", 1, "Pier pier, lantern", "en", "s2"), ("m", 2, "nobody came", "en", "s1"),
    ("n", 0, "le phare et la lantern", "fr", "s1"), ("n", 1, "quiet pier", "fr", "s2"),
]


def ids(df):
    return [(r["document_id"], r["segment_index"]) for r in df.collect()]


def brute_bm25(rows, terms):
    """(score, document, segment) of the segments that have any of the terms, best first."""
    import math

    words = {(d, k): re.findall(r"\w+", text.lower()) for d, k, text, *_ in rows}
    mean = sum(map(len, words.values())) / len(words)
    found = []
    for key, own in words.items():
        score = 0.0
        for t in terms:
            n, df = own.count(t), sum(t in w for w in words.values())
            if n:
                score += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / mean))
        if score:
            found.append((-score, *key))
    return sorted(found)


@pytest.mark.parametrize("asked", ["pier", "lantern", "quiet pier", "lantern PIER phare", "nobody"])
def test_bm25_equals_brute_force(spark, asked):
    got = [(r["document_id"], r["segment_index"], r["score"]) for r in lexical.search(segments(spark, PORT), SearchQuery(asked)).collect()]
    expected = brute_bm25(PORT, asked.lower().split())
    assert [g[:2] for g in got] == [e[1:] for e in expected]
    assert [g[2] for g in got] == pytest.approx([-e[0] for e in expected])


def test_bm25_filters(spark):
    rows = segments(spark, PORT)
    assert sorted(ids(lexical.search(rows, SearchQuery("Lantern pier", all_terms=True)))) == [("m", 0), ("m", 1)]
    assert ids(lexical.search(rows, SearchQuery("pier", phrase=" Quiet PIER"))) == [("n", 1), ("m", 0)]
    assert ids(lexical.search(rows, SearchQuery("lantern", speaker_refs=("s1",), languages=("fr",), document_ids=("n",)))) == [("n", 0)]
    assert ids(lexical.search(rows, SearchQuery("pier", speaker_refs=("s2",), languages=("de",)))) == []


def test_filters_do_not_change_scores(spark):
    rows = segments(spark, PORT)
    score = lambda q: {(r["document_id"], r["segment_index"]): r["score"] for r in lexical.search(rows, q).collect()}
    assert score(SearchQuery("pier", languages=("fr",))) == {("n", 1): score(SearchQuery("pier"))["n", 1]}


def test_scope_none_and_empty(spark):
    rows, q = segments(spark, PORT), SearchQuery("lantern")
    assert len(ids(lexical.search(rows, q, None))) == 3
    assert ids(lexical.search(rows, q, rows.limit(0))) == []
    assert ids(lexical.search(rows, q, rows.filter("document_id = 'n'"))) == [("n", 0)]
    assert ids(lexical.search(rows, q, rows.filter("document_id = 'n'").withColumn("canonical_sha256", F.lit("old")))) == []


def test_timeline_sorts_before_it_limits(spark):
    rows = segments(spark, PORT).withColumn("start_seconds", 9.0 - F.col("segment_index"))
    q = SearchQuery("pier", document_ids=("m",), timeline=True, limit=1)
    hits = lexical.search(rows, q)
    assert ids(hits) == [("m", 1)]
    assert lexical.ranked(hits, q).first()["lexical_rank"] is None


def test_index_gives_the_same_hits(spark):
    rows, q = segments(spark, PORT), SearchQuery("lantern pier quiet")
    scan = [(r["segment_id"], r["document_id"], round(r["score"], 9), r["matched_terms"]) for r in lexical.search(rows, q).collect()]
    index = [(r["segment_id"], r["document_id"], round(r["score"], 9), r["matched_terms"]) for r in lexical.search_index(lexical.terms(rows), lexical.corpus_stats(rows), rows, q).collect()]
    assert scan == index


@pytest.mark.parametrize("wrong", [{"text": " "}, {"text": "---"}, {"text": "a", "limit": 0}, {"text": "a", "limit": 1001}, {"text": "a", "languages": ("x", "x")}, {"text": "a", "phrase": " "}])
def test_wrong_queries(wrong):
    with pytest.raises(ValueError, match="."):
        SearchQuery(**wrong)


def test_no_segments(spark):
    rows = segments(spark, [])
    assert lexical.search(rows, SearchQuery("a")).count() == 0
    assert tuple(lexical.corpus_stats(rows).first()) == (0.0, 0.0)


# ---- chunks, vectors, fusion


def greedy(sizes, target, most):
    out, current, total = [], 0, 0
    parts = 0
    for w in sizes:
        if parts and (total >= target or total + w > most):
            current, total, parts = current + 1, 0, 0
        out.append(current)
        total, parts = total + w, parts + 1
        if total >= most:
            current, total, parts = current + 1, 0, 0
    return out


def test_chunk_assignment(spark):
    sizes = {"a": [2, 2, 2], "b": [12, 1, 1], "c": [1] * 9, "d": [4, 4, 0, 3, 5, 1, 1, 1, 9, 2, 2]}
    rows = segments(spark, [(d, i, " ".join(["w"] * n) or " ", "en", None) for d, own in sizes.items() for i, n in enumerate(own)])
    got = {}
    for r in semantic.chunk_assignment(rows, 3, 4).orderBy("document_id", "segment_index").collect():
        got.setdefault(r["document_id"], []).append(r["chunk_no"])
    assert got == {d: greedy([max(1, n) for n in own], 3, 4) for d, own in sizes.items()}
    assert got["a"] == [0, 0, 1]


def test_chunk_build_and_bridge(spark):
    rows = segments(spark, [("a", 0, " one two ", "en", "s1"), ("a", 1, "three four", "fr", "s1"), ("a", 2, "five six", None, None)])
    chunks = semantic.chunks(rows, 3, 4)
    first = chunks.filter("chunk_no = 0").first()
    assert (first["segment_ids"], first["text"], first["languages"], first["speaker_refs"]) == (["segment-000000", "segment-000001"], "one two three four", ["en", "fr"], ["s1"])
    digest = hashlib.sha256(b"one two three four").hexdigest()
    assert first["chunk_id"] == "chunk-" + hashlib.sha256(f"chunks-v1\0a\0segment-000000\0segment-000001\0{digest}".encode()).hexdigest()
    links = semantic.bridge(chunks)
    assert links.count() == 3
    assert semantic.missing_bridge(chunks, links).count() == 0
    both = links.unionByName(links.withColumn("chunk_id", F.lit("zzz")))
    assert {r["chunk_id"] for r in semantic.segment_to_chunk(rows.select("document_id", "segment_id"), both).collect()} == {"zzz"}


def test_rrf_order(spark):
    lex = spark.createDataFrame([("d", "s1", 1), ("d", "s2", 2), ("d", "lost", 3)], "document_id string, segment_id string, lexical_rank int")
    links = spark.createDataFrame([("d", "s1", "a"), ("d", "s2", "b")], "document_id string, segment_id string, chunk_id string")
    sem = spark.createDataFrame([("b", 1), ("c", 2)], "chunk_id string, semantic_rank int")
    fused = fusion.fuse(fusion.collapse(lex, links), sem, 10).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in fused] == ["b", "a", "c"]
    assert fused[0]["fused_score"] == pytest.approx(1 / 62 + 1 / 61)
    assert fusion.candidates(3) == 100
    assert fusion.candidates(900) == 1000


def test_index_rounds_before_its_limit(spark):
    """Scores that differ in the last places only are ties, and the smallest documents win."""
    index = spark.createDataFrame([(k, "s", "a", 1 if k < 9 else 2, 1000) for k in range(20)], "document_id long, segment_id string, term string, term_frequency long, token_count long")
    rows = spark.createDataFrame([(k, "s", "a", 0.0) for k in range(20)], "document_id long, segment_id string, text string, start_seconds double")
    stats = spark.createDataFrame([(1e4, 1e-6)], "segment_count double, average_length double")
    hits = lexical.search_index(index, stats, rows, SearchQuery("a", limit=5), places=6)
    assert [r["document_id"] for r in hits.collect()] == [0, 1, 2, 3, 4]
    assert [r["document_id"] for r in lexical.search_index(index, stats, rows, SearchQuery("a", limit=5)).collect()] == [9, 10, 11, 12, 13]


def test_fingerprint_has_no_limit_of_size(spark):
    """More than a million documents, in any order, have the digest of their sorted lines."""
    n = 1_000_100
    ids = F.pmod(F.col("id") * 7919, F.lit(n))
    docs = spark.range(n).select(ids.alias("document_id"), F.concat(F.lit("h"), ids.cast("string")).alias("canonical_sha256"))
    expected = hashlib.sha256("".join(f"{k}\0h{k}\0" for k in sorted(map(str, range(n)))).encode()).hexdigest()
    assert tuple(semantic.fingerprint(docs).first()) == (expected, n)
    assert tuple(semantic.fingerprint(docs.limit(0)).first()) == (hashlib.sha256(b"").hexdigest(), 0)


def test_fingerprints(spark):
    docs = spark.createDataFrame([("b", "2" * 64), ("a", "1" * 64)], "document_id string, canonical_sha256 string")
    expected = hashlib.sha256(("a\0" + "1" * 64 + "\0b\0" + "2" * 64 + "\0").encode()).hexdigest()
    assert tuple(semantic.fingerprint(docs).first()) == (expected, 2)
    assert semantic.fingerprint_tree(docs).first() != semantic.fingerprint_tree(docs.limit(1)).first()
    assert semantic.fingerprint_tree(docs.limit(0)).first()["documents"] == 0


def test_workspace_modes(spark):
    rows = segments(spark, PORT)
    chunks = hashed_vectors(semantic.chunks(rows, 1, 1), dimensions=16)
    assert chunks.filter(~V.is_valid(F.col("vector"), 16)).count() == 0

    def embed(text):
        assert text.startswith("query: ")
        return hashed_vectors(column(spark, text.removeprefix("query: ")), "x", 16).first()["vector"]

    work = Workspace(rows, chunks, embed_query=embed, fingerprint="f", current_fingerprint="f")
    q = SearchQuery("phare lantern", limit=2)
    assert work.search(q, "semantic").first()["document_id"] == "n"
    hybrid = work.search(q, "hybrid").collect()
    assert [r["fused_rank"] for r in hybrid] == [1, 2]
    assert hybrid[0]["document_id"] == "n"
    scope = rows.filter("document_id = 'm' AND segment_index = 1").drop("canonical_sha256").withColumn("canonical_sha256", F.lit("sha-m"))
    assert {r["document_id"] for r in work.search(q, "semantic", scope).collect()} == {"m"}
    with pytest.raises(ValueError, match="older"):
        Workspace(rows, chunks, embed_query=embed, fingerprint="f", current_fingerprint="g").search(q, "semantic")
    with pytest.raises(ValueError, match="unknown mode"):
        work.search(q, "fuzzy")


def test_saved_searches(spark):
    q = SearchQuery("a b", languages=("en",), limit=7, timeline=True)
    assert intent_from_json(intent_to_json(q)) == q
    with pytest.raises(ValueError, match="unknown"):
        intent_from_json('{"text": "a", "other": 1}')
    saved = spark.createDataFrame([("7", "Straße  nord"), ("x", "7")], "saved_search_id string, name string")
    assert find_saved(saved, "7").first()["saved_search_id"] == "7"
    assert find_saved(saved, " STRASSE nord").first()["saved_search_id"] == "7"
    assert find_saved(saved, "none").count() == 0


# ---- research

NOTES = [(1, "d", "red", "c1", "alpha beta"), (1, "d", "blue", "c1", "alpha beta"), (2, "d", "red", "c2", "gamma"), (3, "e", "blue", "c1", "alpha")]


def test_notes_match_on_one_note(spark):
    notes = spark.createDataFrame(NOTES, "note_id long, document_id string, tag string, collection string, body string")
    found = lambda *a, **k: sorted(r[0] for r in research.matching_notes(notes, *a, **k).collect())
    assert found() == [1, 2, 3]
    assert found(["red", "blue"]) == [1]
    assert found(["red"], note_text="alpha") == [1]
    assert found(["red"], ["c2"], "alpha") == []
    assert found(note_text="...") == []
    assert found(document_ids=["e"]) == [3]


def test_resolve_all_or_nothing(spark):
    tags = spark.createDataFrame([(1, "Red"), (2, "Blue")], "tag_id long, tag string")
    assert research.resolve(tags, [" RED", "blue"], "tag_id", "tag") == [1, 2]
    assert research.resolve(tags, ["red", "green"], "tag_id", "tag") is None
    assert research.resolve(tags, [], "tag_id", "tag") == []


def test_summaries_and_views(spark):
    ns = spark.createDataFrame([(1, "d", "s0"), (2, "d", "s0"), (2, "d", "s1")], "note_id long, document_id string, segment_id string")
    tags = spark.createDataFrame([(1, "red"), (1, "blue"), (2, "red")], "note_id long, tag string")
    none = spark.createDataFrame([], "note_id long, collection string")
    rows = {r["segment_id"]: r for r in research.summaries(ns, tags, none, ["document_id", "segment_id"]).collect()}
    assert (rows["s0"]["note_ids"], rows["s0"]["tags"], rows["s0"]["collections"]) == ([1, 2], ["blue", "red"], [])
    assert rows["s1"]["tags"] == ["red"]


def test_navigation_limits(spark):
    use = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9)], "tag string, at long")
    assert [r["tag"] for r in research.navigation(use, "tag", "at").collect()] == ["a", "b"]
    assert [r["tag"] for r in research.navigation(use, "tag", "at", by_recency=True).collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="limit"):
        research.navigation(use, "tag", "at", limit=101)


def test_listings_differ_in_order(spark):
    notes = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "note_id long, updated_at long")
    assert [r[0] for r in research.notes_listing(notes).collect()] == [2, 3, 1]
    assert [r[0] for r in research.filtered_listing(notes, notes.select("note_id"), 2).collect()] == [1, 2]


# ---- intervals and speakers


def test_touching_is_not_overlap_and_pairs_come_once(spark):
    a = spark.createDataFrame([("d", 0.0, 200.0), ("d", 200.0, 300.0)], "document_id string, s double, e double")
    b = spark.createDataFrame([("d", 50.0, 250.0), ("d", 300.0, 310.0), ("x", 0.0, 500.0)], "document_id string, ts double, te double")
    got = overlap_join(a, b, ["document_id"], ("s", "e"), ("ts", "te"), 60.0).select("s", "ts").collect()
    assert sorted(map(tuple, got)) == [(0.0, 50.0), (200.0, 50.0)]


def turns(spark, rows):
    return spark.createDataFrame([("d", who, s, e) for who, s, e in rows], "document_id string, speaker_ref string, start_seconds double, end_seconds double")


def test_word_spans(spark):
    words = spark.createDataFrame(
        [("d", "s", 0, 0, " one", "s1", 0.0, 0.8), ("d", "s", 0, 1, " both", "s1", 0.8, 1.2), ("d", "s", 0, 2, " two", "s2", 1.2, 1.8), ("d", "s", 0, 3, " more", "s2", 1.8, 2.0), ("d", "s", 0, 4, " none", None, 2.0, 2.2)],
        "document_id string, segment_id string, segment_index int, word_index int, word string, speaker_ref string, start_seconds double, end_seconds double",
    )
    spans = speakers.word_spans(words, turns(spark, [("s1", 0.0, 1.2), ("s2", 0.8, 2.2)])).orderBy("span_no").collect()
    assert [(r["kind"], r["speaker_refs"], r["text"]) for r in spans] == [("single-speaker", ["s1"], "one"), ("overlap", ["s1", "s2"], "both"), ("single-speaker", ["s2"], "two more"), ("unattributed", [], "none")]
    assert spans[2]["end_seconds"] == 2.0


@pytest.mark.parametrize(
    ("speaker", "given", "kind", "refs"),
    [
        ("s9", [("s1", 0.0, 5.0)], "single-speaker", ["s9"]),
        (None, [("s1", 0.0, 5.0)], "unattributed", []),
        (None, [], "unattributed", []),
        (None, [("s1", 0.0, 2.0), ("s2", 2.0, 5.0)], "mixed-unresolved", ["s1", "s2"]),
        (None, [("s1", 0.0, 3.0), ("s2", 2.0, 5.0)], "overlap", ["s1", "s2"]),
        (None, [("s1", 0.0, 2.0), ("s2", 2.0, 5.0), ("s1", 6.0, 9.0), ("s2", 6.0, 9.0)], "mixed-unresolved", ["s1", "s2"]),
    ],
)
def test_segment_kinds(spark, speaker, given, kind, refs):
    rows = segments(spark, [("d", 0, " text ", "en", speaker)])
    row = speakers.segment_spans(rows, turns(spark, given)).first()
    assert (row["kind"], row["speaker_refs"], row["text"]) == (kind, refs, "text")


def test_projection_of_words_and_segments(spark):
    words = spark.createDataFrame([("d", "s", 0, 0.0, 1.0), ("d", "s", 1, 1.0, 2.0), ("d", "t", 0, 5.0, 6.0)], "document_id string, segment_id string, word_index int, start_seconds double, end_seconds double")
    got = speakers.project(words, turns(spark, [("s1", 0.0, 1.5), ("s2", 1.2, 2.0), ("s3", 4.0, 9.0)]), ["document_id", "segment_id", "word_index"])
    assert {(r["segment_id"], r["word_index"]): r["speaker_ref"] for r in got.collect()} == {("s", 0): "s1", ("s", 1): None, ("t", 0): "s3"}
    assert {r["segment_id"]: r["speaker_ref"] for r in speakers.segment_refs(got).collect()} == {"s": None, "t": "s3"}


def test_numbering(spark):
    rows = turns(spark, [("zoe", 0.0, 1.0), ("ann", 2.0, 3.0), ("zoe", 4.0, 5.0)]).withColumnRenamed("speaker_ref", "label")
    assert {(r["label"], r["speaker_ref"]) for r in speakers.numbered(rows).collect()} == {("zoe", "speaker-01"), ("ann", "speaker-02")}


def test_roster_and_labels(spark):
    rows = segments(spark, [("d", 0, "a", "en", "s1"), ("d", 1, "b", "en", "s2"), ("d", 2, "c", "en", None)])
    labels = spark.createDataFrame([("d", "old", "s1", "Ann")], "document_id string, canonical_sha256 string, speaker_ref string, label string")
    assert {(r["speaker_ref"], r["display_name"]) for r in speakers.roster(rows, labels).collect()} == {("s1", "Ann (s1)"), ("s2", "s2")}
    docs = spark.createDataFrame([("d", "new")], "document_id string, canonical_sha256 string")
    assert speakers.label_views(labels, docs).first()["current"] is False


# ---- evidence


def test_phrase_search_and_phrase_highlight_can_disagree(spark):
    rows = segments(spark, [("d", 0, "rehousing pricesetting", "en", None)])
    assert lexical.search(rows, SearchQuery("rehousing", phrase="housing price")).count() == 1
    words = spark.createDataFrame([("d", "segment-000000", 0, "rehousing", 0.0), ("d", "segment-000000", 1, "pricesetting", 1.0)], "document_id string, segment_id string, word_index int, word string, start_seconds double")
    assert evidence.highlights(rows, words, "housing price", phrase=True).first()["highlighted"] == []


@pytest.mark.parametrize(("query", "phrase", "expected", "seek"), [("b a", False, [0, 1, 2, 3], 0.0), ("a b", True, [0, 1, 2, 3], 0.0), ("b a b", True, [1, 2, 3], 1.0), ("b b", True, [], 0.0), ("zz", False, [], 0.0)])
def test_highlights(spark, query, phrase, expected, seek):
    rows = segments(spark, [("d", 0, "a b a b c", "en", None)])
    words = spark.createDataFrame([("d", "segment-000000", k, w, float(k)) for k, w in enumerate("A b, a b c".split())], "document_id string, segment_id string, word_index int, word string, start_seconds double")
    row = evidence.highlights(rows, words, query, phrase).first()
    assert (row["highlighted"], row["seek_seconds"]) == (expected, seek)


def test_context(spark):
    rows = segments(spark, [("d", i, f"t{i}", "en", None) for i in range(6)])
    hits = spark.createDataFrame([("h", "d", 0, 1), ("k", "d", 5, 5)], "hit_id string, document_id string, first_index int, last_index int")
    got = {}
    for r in evidence.context(hits, rows, 2).orderBy("segment_index").collect():
        got.setdefault(r["hit_id"], []).append((r["segment_index"], r["is_match"]))
    assert got == {"h": [(0, True), (1, True), (2, False), (3, False)], "k": [(3, False), (4, False), (5, True)]}
    with pytest.raises(ValueError, match="around"):
        evidence.context(hits, rows, 11)


def test_candidates_at_points_and_ranges(spark):
    rows = segments(spark, [("d", i, "t", "en", None) for i in range(3)])
    notes = spark.createDataFrame(
        [(1, "d", "old", "src", 5.0, 5.0), (2, "d", "old", "src", 5.0, 7.0), (3, "d", "new", "src", 5.0, 7.0), (4, "d", "old", "other", 5.0, 7.0), (5, "d", "old", "src", 90.0, 95.0)],
        "note_id long, document_id string, canonical_sha256 string, source_sha256 string, start_seconds double, end_seconds double",
    )
    docs = spark.createDataFrame([("d", "new", "src")], "document_id string, canonical_sha256 string, source_sha256 string")
    found = evidence.candidate_anchors(notes, docs, rows)
    assert {r["note_id"]: r["segment_ids"] for r in found.collect()} == {1: ["segment-000000", "segment-000001"], 2: ["segment-000001"]}
    status = {r["note_id"]: r["status"] for r in evidence.review(notes, docs, found).collect()}
    assert status == {1: "older_verified", 2: "older_verified", 3: "current_verified", 4: "unavailable", 5: "unavailable"}


def test_anchor_history(spark):
    rows = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "note_id long, at long")
    got = {(r["note_id"], r["at"]): (r["revision"], r["is_current"]) for r in evidence.anchor_history(rows, "note_id", ["at"]).collect()}
    assert got == {(1, 10): (1, False), (1, 20): (2, True), (2, 5): (1, True)}


# ---- language and assembly


def test_units_and_projection(spark):
    docs = spark.createDataFrame([("d", " Hello, world!\n ok ")], "document_id string, text string")
    units = language.text_units(docs).orderBy("start_char").collect()
    assert [(r["start_char"], r["end_char"], r["unit"]) for r in units] == [(1, 7, "Hello,"), (8, 14, "world!"), (16, 18, "ok")]
    rows = segments(spark, [("d", 0, "ab cd", "en", None), ("d", 1, "ef", "en", None)])
    spans = spark.createDataFrame([("d", 0, 3, "en", 0.9), ("d", 3, 8, "fr", 0.8)], "document_id string, start_char long, end_char long, language string, confidence double")
    got = language.project_spans(rows, spans)
    assert sorted((r["segment_id"], r["start_char"], r["end_char"], r["language"]) for r in got.collect()) == [("segment-000000", 0, 2, "en"), ("segment-000000", 3, 5, "fr"), ("segment-000001", 0, 2, "fr")]
    assert {r["segment_id"]: r["language"] for r in language.segment_languages(got).collect()} == {"segment-000000": None, "segment-000001": "fr"}
    assert language.detected_languages(got, ["segment_id", "start_char"]).first()["detected_languages"] == ["en", "fr"]


def test_windows_and_rebase(spark):
    recordings = spark.createDataFrame([("d", 2500, 1), ("e", 0, 1)], "document_id string, frames long, sample_rate_hz long")
    windows = assembly.window_plan(recordings, 1000)
    assert [(r["window_id"], r["start_frame"], r["end_frame"]) for r in windows.orderBy("window_index").collect()] == [("audio-000000", 0, 1000), ("audio-000001", 1000, 2000), ("audio-000002", 2000, 2500)]
    assert assembly.window_violations(windows).count() == 0
    schema = "document_id string, window_index int, local_index int, start_seconds double, end_seconds double, text string, language string"
    results = spark.createDataFrame([("d", 2, 0, 499.0, 500.04, "z", "en"), ("d", 0, 0, 0.0, 999.9999999999, "a", "en"), ("d", 0, 1, 3.0, 4.0, "b", "en")], schema)
    rows = assembly.assemble(windows, results).orderBy("segment_index").collect()
    assert [(r["text"], r["start_seconds"], r["end_seconds"]) for r in rows] == [("a", 0.0, 1000.0), ("b", 3.0, 4.0), ("z", 2499.0, 2500.0)]
    with pytest.raises(Exception, match="outside their window"):
        assembly.assemble(windows, spark.createDataFrame([("d", 0, 0, 0.0, 1000.06, "a", "en")], schema)).collect()
    assert assembly.complete_prefix(windows.filter("window_index <> 1")).first()["complete"] == 1


# ---- exports, custody, checks


def test_exports(spark):
    rows = segments(spark, [("d", 0, " Hi \nthere", "en", "s1"), ("d", 1, "bye", "en", None)])
    assert export.srt(rows).first()["content"] == "1\n00:00:00,000 --> 00:00:05,000\n[s1] Hi there\n\n2\n00:00:05,000 --> 00:00:10,000\nbye\n\n"
    assert export.vtt(rows).first()["content"].startswith("WEBVTT\n\nsegment-000000\n00:00:00.000 --> 00:00:05.000\n[s1] Hi there\n\n")
    assert export.txt(rows).first()["content"] == "[s1] Hi there\nbye\n"
    assert export.txt(rows.withColumn("speaker_ref", F.lit(None).cast("string"))).first()["content"] == " Hi \nthere\nbye\n"


def test_retention(spark):
    jobs = spark.createDataFrame([(1, "completed", "2024-01-01"), (2, "running", "2024-01-01"), (3, "failed", "2024-01-01"), (4, "completed", "2024-03-01")], "job_id long, status string, at string").withColumn("updated_at", F.to_timestamp("at"))
    jobs = jobs.withColumn("workspace_path", F.concat(F.lit("/jobs/"), "job_id"))
    cutoff = F.lit("2024-02-01").cast("timestamp")
    assert [r["job_id"] for r in custody.retention_candidates(jobs, cutoff, False).collect()] == [1]
    both = custody.retention_candidates(jobs, cutoff, True)
    assert {r["job_id"]: r["resume_lost"] for r in both.collect()} == {1: False, 3: True}
    assert custody.retention_token(both, 30, True).first()[1] != custody.retention_token(both.limit(1), 30, True).first()[1]
    assert custody.retention_token(both, 30, True).first()[1] != custody.retention_token(both.withColumn("workspace_path", F.lit("/x")), 30, True).first()[1]
    assert custody.retention_token(both.limit(0), 30, True).first()[0] == 0


def test_deletion(spark):
    docs = spark.createDataFrame([("d", "c" * 64)], "document_id string, canonical_sha256 string")
    notes = spark.createDataFrame([(1, "d"), (2, "x")], "note_id long, document_id string")
    saved = spark.createDataFrame([(9, "d")], "saved_search_id long, document_id string")
    assert custody.effective_scopes(["canonical-transcript"]) == ["library-view", "derived-artifacts", "execution-state", "canonical-transcript"]
    with pytest.raises(ValueError, match="scopes"):
        custody.effective_scopes([])
    actions = custody.deletion_actions(docs, notes, saved, ["library-view"])
    assert sorted((r["target"], r["fate"]) for r in actions.collect()) == [("library-view", "action"), ("research-note", "preserved"), ("saved-search", "affected")]
    plan = custody.deletion_plans(actions, docs, ["library-view"]).first()
    assert (plan["n_actions"], plan["n_preserved"], plan["n_affected"]) == (1, 1, 1)
    assert plan["confirmation_token"].startswith("delete:d:cccccccccccc:")
    token = lambda saved, scopes: custody.deletion_plans(custody.deletion_actions(docs, notes, saved, scopes), docs, scopes).first()["confirmation_token"]
    whole = ["canonical-transcript"]
    assert len({token(saved, ["library-view"]), token(saved.limit(0), ["library-view"]), token(saved, whole), token(saved, [*whole, "library-view"])}) == 4  # the last two take the same, but ask otherwise


def test_violations(spark):
    rows = segments(spark, [("d", 0, "a", "en", "s1"), ("d", 2, " ", "en", None)])
    assert [(r["segment_id"], r["problem"]) for r in validation.segment_violations(rows).collect()] == [("segment-000002", "text")]
    durations = spark.createDataFrame([("d", 10.0)], "document_id string, duration_seconds double")
    assert {r["problem"] for r in validation.document_violations(rows, turns(spark, [("s2", 0.0, 11.0)]), durations).collect()} == {"index", "speaker", "duration"}


# ---- incremental, sources, streaming


def test_refresh_delta_and_apply(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("e", "1", 1)], "document_id string, canonical_sha256 string, modified_ns long")
    new = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("d", "1", 1), ("e", "1", 2)], "document_id string, canonical_sha256 string, modified_ns long")
    got = {r["document_id"]: (r["status"], r["semantic_dirty"]) for r in incremental.refresh_delta(old, new).collect()}
    assert got == {"a": ("unchanged", False), "b": ("updated", True), "c": ("removed", True), "d": ("added", True), "e": ("updated", False)}
    after = incremental.apply_delta(old, new.filter("document_id IN ('b', 'd', 'e')"), old.filter("document_id = 'c'").select("document_id"))
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, new.collect()))
    none = old.select("document_id").limit(0)
    for upserts, removals, problem in (
        (new, old.select("document_id"), "both"), (new.unionByName(new.limit(1)), none, "duplicate upsert"), (new.limit(0), old.select("document_id").unionByName(old.select("document_id")), "duplicate removal"),
        (new.limit(0), spark.createDataFrame([("  ",)], "document_id string"), "blank"), (new.limit(0), spark.createDataFrame([(None,)], "document_id string"), "blank"),
    ):
        with pytest.raises(ValueError, match=problem):
            incremental.apply_delta(old, upserts, removals)
    segments = spark.createDataFrame([("b", 0), ("b", 1), ("c", 0)], "document_id string, segment_index int")
    after = incremental.apply_delta(segments, segments.filter("document_id = 'b'"), none, upserted=spark.createDataFrame([("b",)], "document_id string"))
    assert after.count() == 3


def test_sequence_and_log(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(4)
    log = incremental.with_sequence(rows, ["k"], after=10)
    assert [r["sequence_id"] - r["k"] for r in log.collect()] == [11] * 1000
    assert incremental.batch_after(log, 1005).count() == 5
    assert incremental.has_gap(log, 9) and not incremental.has_gap(log, 10)
    assert incremental.has_gap(log.limit(0), 9, 10) and not incremental.has_gap(log.limit(0), 10, 10)
    assert incremental.compacted(log, 1010, 3).count() == 3


def test_sequence_of_more_rows_than_a_sample(spark):
    """Ranges are cut by a sample of rows; counts and places must be of the same ranges, whatever columns are asked for."""
    rows = spark.range(0, 80_000, 1, 8).select((F.col("id") * 7919 % 80_000).alias("k"), F.hash("id").alias("more"))
    log = incremental.with_sequence(rows, ["k"], after=10)
    assert log.filter("sequence_id - k = 11").agg(F.count("k"), F.max("more")).first()[0] == 80_000
    last = log.agg(F.max("sequence_id")).first()[0]
    assert last == 80_010 and incremental.compacted(log, last, 100).count() == 100


def test_sequence_puts_nulls_last(spark):
    rows = spark.createDataFrame([(None, 1), (2, 2), (1, 3), (None, 4)], "k int, m int")
    assert {r["m"]: r["sequence_id"] for r in incremental.with_sequence(rows, ["k", "m"]).collect()} == {3: 1, 2: 2, 1: 3, 4: 4}


def document(job, text, **more):
    return {"schema_version": 1, "job_id": job, "detected_language": "en", "source": {"sha256": "a" * 64, "size_bytes": 1, "modified_ns": 1}, "segments": [{"segment_id": "segment-000000", "index": 0, "start_seconds": 0.0, "end_seconds": 1.0, "text": text, **more}]}


def test_canonical_scan(spark, tmp_path):
    raw = json.dumps(document("a", "hello", language="fr", words=[{"start_seconds": 0.0, "end_seconds": 1.0, "text": " hello"}])).encode()
    (tmp_path / "a.json").write_bytes(raw)
    (tmp_path / "b.json").write_text(json.dumps(document("b", "bye", detected_language="de")))
    (tmp_path / "note.txt").write_text("no")
    loaded = canonical.load(spark, str(tmp_path))
    docs = {r["document_id"]: r for r in canonical.documents(loaded).collect()}
    assert docs["a"]["canonical_sha256"] == hashlib.sha256(raw).hexdigest()
    assert {r["document_id"]: r["language"] for r in canonical.segments(loaded).collect()} == {"a": "fr", "b": "de"}
    assert [r["word"] for r in canonical.words(canonical.segments(loaded)).collect()] == [" hello"]
    index = canonical.documents(loaded)
    (tmp_path / "b.json").write_text(json.dumps(document("b", "changed")))
    kept = spark.createDataFrame([tuple(r) for r in docs.values()], index.schema)
    assert {r["document_id"]: r["intact"] for r in canonical.verified(canonical.load(spark, str(tmp_path)), kept).collect()} == {"a": True, "b": False}
    (tmp_path / "c.json").write_text("{broken")
    with pytest.raises(ValueError, match="malformed"):
        canonical.load(spark, str(tmp_path))
    assert canonical.load(spark, str(tmp_path), strict=False).count() == 2
    (tmp_path / "d.json").write_text(json.dumps(document("a", "again")))
    with pytest.raises(ValueError, match="two transcripts"):
        canonical.load(spark, str(tmp_path), strict=False)


def test_recordings(spark):
    rows = spark.createDataFrame([("/r/a.WAV", 5, "x", False), ("/r/a.WAV", 5, "y", True), ("/r/.b.wav", 5, "x", False), ("/r/c.wav", 0, "x", False), ("/r/d.txt", 5, "x", False)], "path string, size long, location_id string, automatic boolean")
    assert [tuple(r) for r in canonical.recordings(rows).collect()] == [("/r/a.WAV", 5, ["x", "y"], True)]


def test_generations_survive_a_failed_write(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    generations.publish(spark, root, {"t": spark.range(3)}, 5)
    bad = spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        generations.publish(spark, root, {"t": bad}, 6)
    assert generations.read(spark, root, "t").count() == 3
    with pytest.raises(ValueError, match="behind"):
        generations.publish(spark, root, {"t": spark.range(1)}, 4)
    generations.publish(spark, root, {"t": spark.range(1)}, 6)
    assert generations.read(spark, root, "t").count() == 1


def test_outbox_replay_equals_rebuild(spark, tmp_path):
    log, root = f"file://{tmp_path}/log", f"file://{tmp_path}/projection"
    add = lambda *rows: spark.createDataFrame(list(rows), outbox.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(log)
    state = spark.createDataFrame([(10, "new"), (12, "c")], "note_id long, body string")  # note 11 is gone
    run = lambda now: outbox.replay(spark, log, root, f"file://{tmp_path}/checkpoint", lambda: now, buckets=8)
    rows = lambda: sorted(map(tuple, outbox.read(spark, root, state).collect()))
    add((1, 10), (2, 11))
    add((3, 12), (4, 10))
    run(state)
    assert rows() == [(10, "new"), (12, "c")]
    assert generations.current(spark, root)[1] == 4
    later = state.unionByName(spark.createDataFrame([(13, "d"), (14, "e")], state.schema))
    add((5, 13))
    run(later)
    assert rows() == [(10, "new"), (12, "c"), (13, "d")]  # 14 has no change yet
    add((9, 13))  # changes 6 to 8 are lost
    run(later)
    assert rows() == [(10, "new"), (12, "c"), (13, "d"), (14, "e")]
    for _ in range(2):
        outbox.rebuild(spark, root, state, 9, buckets=8)
    assert rows() == [(10, "new"), (12, "c")]
    folders = lambda: {p.name for p in (tmp_path / "projection").iterdir() if p.is_dir()}
    assert len(folders()) > 3  # readers of older generations still have their files
    (tmp_path / "projection" / "foreign").mkdir()
    generations.drop_superseded(spark, root, 2, grace=0)
    assert len(folders()) == 4 and "foreign" in folders()  # two generations, the pointers, and what is not ours
    assert rows() == [(10, "new"), (12, "c")]


def test_catch_up(spark, tmp_path):
    root = f"file://{tmp_path}/projection"
    notes = lambda n: spark.createDataFrame([(k, f"v{n}") for k in range(10) if k != n % 10], "note_id long, body string")
    log = lambda first, last: spark.createDataFrame([(k, k % 10) for k in range(first, last + 1)], outbox.LOG_SCHEMA)
    run = lambda lines, n, **more: outbox.catch_up(spark, root, lambda: lines, lambda: notes(n), lambda: n, buckets=4, **more)
    assert run(log(1, 25), 25, size=10) == outbox.Report(0, 25, 25, 3, False)
    same = lambda n: sorted(map(tuple, outbox.read(spark, root, notes(n)).collect())) == sorted(map(tuple, notes(n).collect()))
    assert same(25)
    assert run(log(1, 25), 25) == outbox.Report(25, 25, 25, 0, False)
    assert run(log(30, 40), 40) == outbox.Report(25, 40, 40, 1, True)  # compacted past the watermark
    assert same(40)
    assert run(log(1, 0), 41) == outbox.Report(40, 41, 41, 1, True)  # nothing is left of the log
    with pytest.raises(ValueError, match="ahead"):
        run(log(1, 5), 5)
    with pytest.raises(RuntimeError, match="batches"):
        run(log(42, 60), 60, size=5, most=2)


def test_cue_text_cuts_lines_as_python(spark):
    texts = ["a", " a  b ", "a\nb", "a\r\n\r\n b\r", "\n\ta \x0b\x0c\n\n", "a\u0085b", " a\n　b ", "a\rb", "\r\na", "a\x1cb\n", None]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.cue_text(F.col("t"))).collect()]
    lines = lambda t: t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    assert found == [None if t is None else " ".join(x.strip() for x in lines(t) if x.strip()) for t in texts]
    for bad in ("", " \n\r", "a\x00b", "　"):
        with pytest.raises(Exception, match="cannot be exported"):
            spark.createDataFrame([(bad,)], "t string").select(T.cue_text(F.col("t"))).collect()
