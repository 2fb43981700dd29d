from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import changes, evidence, research, validation
from quillon.plans.workspace import PASSAGE_PREFIX, Workspace, hashed_vectors, profile_id, rebuild, store
from quillon.operators.lexical import SearchQuery
from quillon.operators import semantic
from quillon.sources import canonical, generations


def test_versions_equal_brute_force(spark):
    rng = random.Random(3)
    state = {k: rng.randint(1, 3) for k in range(8)}
    asked = [(n, rng.randint(0, 11), rng.choice(["create", "update", "update", "delete", "other"]), rng.randint(1, 4)) for n in range(120)]
    now, expected = dict(state), []
    for n, k, op, version in asked:
        there = now.get(k)
        if op == "other":
            said = "invalid"
        elif op == "create":
            said = "exists" if there else "applied"
        else:
            said = "missing" if not there else "conflict" if there != version else "applied"
        if said == "applied":
            if op == "delete":
                del now[k]
            else:
                now[k] = 1 if op == "create" else there + 1
        expected.append((n, said, now.get(k)))
    frame = spark.createDataFrame([(k, v, f"b{k}") for k, v in state.items()], "note_id int, version int, body string")
    lines = spark.createDataFrame([(*a, f"new{a[0]}") for a in asked], "sequence_id long, note_id int, op string, expected_version int, body string")
    after, done = changes.apply_versioned(frame, lines, "note_id")
    assert sorted((r["sequence_id"], r["outcome"], r["version"]) for r in done.collect()) == sorted(expected, key=lambda e: e[0])
    assert {r["note_id"]: r["version"] for r in after.collect()} == now
    assert changes.apply_versioned(frame, lines.limit(0), "note_id")[0].count() == len(state)


def test_names_stay_unique(spark):
    saved = spark.createDataFrame([(1, 1, "Port"), (2, 1, "Pier")], "saved_search_id int, version int, name string")
    asked = spark.createDataFrame(
        [(1, 3, "create", None, " PORT "), (2, 4, "create", None, "Mole"), (3, 5, "create", None, "mole"), (4, 2, "update", 1, "Quay"), (5, 6, "create", None, "  "), (6, 2, "update", 1, "Late")],
        "sequence_id long, saved_search_id int, op string, expected_version int, name string",
    )
    after, done = changes.apply_versioned(saved, asked, "saved_search_id", name="name")
    assert {r["sequence_id"]: r["outcome"] for r in done.collect()} == {1: "name taken", 2: "applied", 3: "name taken", 4: "applied", 5: "invalid", 6: "conflict"}
    assert {r["saved_search_id"]: (r["version"], r["name"]) for r in after.collect()} == {1: (1, "Port"), 2: (2, "Quay"), 4: (1, "Mole")}


def fold(state, asked):
    """Brute force: the batch in order, one change after the other."""
    now, out = dict(state), []
    for n, k, op, version, name in asked:
        name, there = " ".join(name.casefold().split()), now.get(k)
        if op == "create" and there:
            said = "exists"
        elif op != "create" and not there:
            said = "missing"
        elif op != "create" and there[0] != version:
            said = "conflict"
        elif op != "delete" and not name:
            said = "invalid"
        elif op != "delete" and any(x[1] == name for j, x in now.items() if j != k):
            said = "name taken"
        else:
            said = "applied"
            now.pop(k, None)
            if op != "delete":
                now[k] = (1 if op == "create" else there[0] + 1, name)
        out.append((n, said, now[k][0] if k in now else None))
    return now, out


def test_names_equal_a_fold_of_the_whole_batch(spark):
    """500 batches of creates, renames, deletes and swaps at once, each on keys and names of its own."""
    rng = random.Random(11)
    state, asked, expected, held = [], [], [], {}
    for b in range(500):
        own = {b * 10 + k: (rng.randint(1, 2), f"n{b}-{k}") for k in range(rng.randint(0, 4))}
        rows = [(b * 1000 + n, b * 10 + rng.randrange(6), rng.choice(["create", "update", "update", "delete"]), rng.randint(1, 3), rng.choice([f"N{b}-{rng.randrange(6)}", f" n{b}-{rng.randrange(6)} ", " "])) for n in range(rng.randint(1, 14))]
        after, said = fold(own, rows)
        state += [(k, v, name) for k, (v, name) in own.items()]
        asked, expected = asked + rows, expected + said
        held |= after
    frame = spark.createDataFrame(state, "id long, version int, name string")
    lines = spark.createDataFrame(asked, "sequence_id long, id long, op string, expected_version int, name string")
    after, done = changes.apply_versioned(frame, lines, "id", name="name")
    assert sorted((r["sequence_id"], r["outcome"], r["version"]) for r in done.collect()) == sorted(expected)
    assert {r["id"]: (r["version"], " ".join(r["name"].casefold().split())) for r in after.collect()} == held
    with pytest.raises(ValueError, match="have the number"):
        changes.apply_versioned(frame, lines.unionByName(lines.limit(1)), "id", name="name")
    with pytest.raises(ValueError, match="have the number"):
        changes.outcomes(frame, lines.unionByName(lines.limit(1)), "id")


def test_names_are_whole(spark):
    wanted = spark.createDataFrame([(1, "x", "tar.gz"), (2, "x.tar", "gz"), (3, "x", None), (4, "X", ""), (5, "x.tar", "gz")], "file_id int, stem string, extension string")
    got = {r["file_id"]: r["file_name"] for r in changes.free_names(wanted, wanted.select(F.lit("X-2").alias("file_name")).limit(1)).collect()}
    assert got == {1: "x.tar.gz", 2: "x.tar-2.gz", 3: "x", 4: "X-3", 5: "x.tar-3.gz"}


def test_labels_are_of_one_generation(spark):
    from quillon.operators import speakers

    labels = spark.createDataFrame([("d", "g", "s2", "Ann"), ("d", "old", "s2", "Bo")], "document_id string, canonical_sha256 string, speaker_ref string, label string")
    hits = Workspace(segments(spark), labels=labels).search(SearchQuery("boats day", limit=1)).collect()
    assert len(hits) == 1
    assert [r["display_name"] for r in Workspace(segments(spark), labels=labels).search(SearchQuery("boats")).collect()] == ["Ann (s2)"]
    assert sorted(r["display_name"] for r in speakers.roster(segments(spark), labels).collect()) == ["Ann (s2)", "s1"]


def test_a_move_needs_a_confirmation(spark):
    notes = spark.createDataFrame([(0, "d", ["a"])], "note_id int, document_id string, segment_ids array<string>")
    offered = spark.createDataFrame([(0, "d", ["b"], "g")], "note_id int, document_id string, segment_ids array<string>, canonical_sha256 string")
    asked = spark.createDataFrame([(0, "d", ["b"], None), (0, None, ["b"], "g"), (0, "d", ["b"], "g")], offered.schema)
    assert sorted(r["outcome"] for r in evidence.reanchored(notes, asked, offered).collect()) == ["moved", "other document", "stale"]


def test_relations_are_replaced(spark):
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "note_id int, tag string")
    wanted = spark.createDataFrame([(1, "c"), (1, "c"), (3, None)], "note_id int, tag string")
    assert sorted(map(tuple, changes.replace_relations(tags, wanted, "note_id").collect())) == [(1, "c"), (2, "a")]


def test_labels_are_set_and_removed(spark):
    schema = "document_id string, canonical_sha256 string, speaker_ref string, label string"
    labels = spark.createDataFrame([("d", "g", "s1", "Ann"), ("d", "g", "s2", "Bo"), ("d", "h", "s1", "Old")], schema)
    asked = spark.createDataFrame([("d", "g", "s1", "First", 1), ("d", "g", "s1", " Last ", 2), ("d", "g", "s2", None, 3), ("d", "h", "s1", "x" * 201, 4)], schema + ", sequence_id long")
    after, refused = changes.set_labels(labels, asked)
    assert sorted(tuple(r) for r in after.collect()) == [("d", "g", "s1", "Last"), ("d", "h", "s1", "Old")]
    assert [r["sequence_id"] for r in refused.collect()] == [4]


def test_free_names(spark):
    wanted = spark.createDataFrame([(1, "a", "txt"), (2, "A", "txt"), (3, "a", "srt"), (4, "a-2", "txt"), (5, "a", "txt")], "file_id int, stem string, extension string")
    taken = spark.createDataFrame([("a-3.TXT",)], "file_name string")
    assert {r["file_id"]: r["file_name"] for r in changes.free_names(wanted, taken).collect()} == {1: "a.txt", 2: "A-4.txt", 3: "a.srt", 4: "a-2.txt", 5: "a-5.txt"}


def test_label_files(spark, tmp_path):
    line = '{"document_id":"d","canonical_sha256":"c","speaker_ref":"s1","label":"Ann"}'
    path = tmp_path / "labels.jsonl"
    path.write_text(line + "\n")
    assert canonical.label_states(spark, str(path)).count() == 1
    path.write_text(line + "\n" + line + "\n")
    with pytest.raises(ValueError, match="two labels"):
        canonical.label_states(spark, str(path))
    path.write_text(line.replace('"label"', '"other":1,"label"'))
    with pytest.raises(ValueError, match="not a label"):
        canonical.label_states(spark, str(path))


def segments(spark):
    word = "array<struct<start_seconds:double,end_seconds:double,text:string,probability:double,speaker_ref:string>>"
    rows = [("d", "g", k, f"segment-{k:06d}", t, "en", ref, float(5 * k), float(5 * k + 5), [(5.0 * k, 5.0 * k + 1, " w", 0.9, other)]) for k, (t, ref, other) in enumerate([(" one fine day", "s1", "s1"), ("two boats", "s2", "s3"), ("three", None, None)])]
    return spark.createDataFrame(rows, f"document_id string, canonical_sha256 string, segment_index int, segment_id string, text string, language string, speaker_ref string, start_seconds double, end_seconds double, words {word}")


def test_details_check_the_index(spark):
    index = spark.createDataFrame([("d", "g", 3), ("e", "g", 1)], "document_id string, canonical_sha256 string, segment_count int")
    rows = {r["document_id"]: r for r in canonical.details(segments(spark), index).collect()}
    assert (rows["d"]["segments"], rows["d"]["n_words"], rows["d"]["speakers"], rows["d"]["seconds"], rows["d"]["sound"]) == (3, 3, ["s1", "s2", "s3"], 15.0, True)
    assert rows["e"]["sound"] is False
    wrong = spark.createDataFrame([("d", "g", 2)], index.schema)
    assert canonical.details(segments(spark), wrong).first()["sound"] is False


def test_anchors_are_reopened(spark):
    docs = spark.createDataFrame([("d", "g", "s")], "document_id string, canonical_sha256 string, source_sha256 string")
    ids = [f"segment-{k:06d}" for k in range(3)]
    cases = [("open", "d", ids[:2], 1.0, 9.0, "g"), ("changed", "d", ids[:2], 1.0, 9.0, "old"), ("missing", "x", ids[:1], 1.0, 2.0, "g"), ("broken", "d", [ids[0], ids[2]], 1.0, 9.0, "g"), ("broken", "d", ids[:1], 1.0, 9.0, "g")]
    anchors = spark.createDataFrame([(k, d, i, s, e, c, "s") for k, (_, d, i, s, e, c) in enumerate(cases)], "anchor_id int, document_id string, segment_ids array<string>, start_seconds double, end_seconds double, canonical_sha256 string, source_sha256 string")
    rows = {r["anchor_id"]: r for r in evidence.reopened(anchors, docs, segments(spark)).collect()}
    assert [rows[k]["status"] for k in range(5)] == [c[0] for c in cases]
    assert (rows[0]["text"], rows[0]["seek_seconds"]) == ("one fine day two boats", 1.0)
    assert rows[1]["text"] is None


def test_reanchoring_is_refused_or_done(spark):
    notes = spark.createDataFrame([(k, "d", ["a"]) for k in range(6)], "note_id int, document_id string, segment_ids array<string>")
    offered = spark.createDataFrame([(k, "d", ["b"], "g") for k in range(5)], "note_id int, document_id string, segment_ids array<string>, canonical_sha256 string")
    asked = spark.createDataFrame([(0, "d", ["b"], "g"), (1, "e", ["b"], "g"), (2, "d", ["a"], "g"), (3, "d", ["c"], "g"), (4, "d", ["b"], "old"), (5, "d", ["b"], "g"), (9, "d", ["b"], "g")], offered.schema)
    got = {r["note_id"]: r["outcome"] for r in evidence.reanchored(notes, asked, offered).collect()}
    assert got == {0: "moved", 1: "other document", 2: "same anchor", 3: "no candidate", 4: "stale", 5: "no candidate", 9: "unknown note"}


def test_rebuild_validates_before_it_stores(spark, tmp_path):
    def embed(rows):
        assert rows.filter(~F.col("passage").startswith(PASSAGE_PREFIX)).count() == 0
        return hashed_vectors(rows, "passage", 8)

    built = rebuild(segments(spark), embed, "hashes", 8, target=2, most=4)
    assert {r["profile_id"] for r in built.collect()} == {profile_id("hashes", 8)}
    assert profile_id("hashes", 8) != profile_id("hashes", 16)
    with pytest.raises(ValueError, match="length one"):
        rebuild(segments(spark), lambda rows: hashed_vectors(rows, "passage", 8), "hashes", 16)
    docs = spark.createDataFrame([("d", "g")], "document_id string, canonical_sha256 string")
    root = f"file://{tmp_path}/semantic"
    store(spark, root, built, docs)
    chunks = generations.read(spark, root, "chunks")
    assert generations.read(spark, root, "bridge").count() == 3
    query = lambda text: hashed_vectors(spark.createDataFrame([(text,)], "t string"), "t", 8).first()["vector"]
    found = lambda profile: Workspace(segments(spark), chunks, embed_query=query, profile=profile).search(SearchQuery("two boats", limit=5), "semantic").count()
    assert found(profile_id("hashes", 8)) == chunks.count() and found("profile-other") == 0


def test_hits_tell_speakers(spark):
    labels = spark.createDataFrame([("d", "s2", "Ann")], "document_id string, speaker_ref string, label string")
    hits = Workspace(segments(spark), labels=labels).search(SearchQuery("boats day")).collect()
    assert {r["segment_index"]: r["display_name"] for r in hits} == {0: "s1", 1: "Ann (s2)"}
    assert [r["lexical_rank"] for r in hits] == [1, 2]


def test_chunks_are_linear_in_a_document(spark):
    import time

    long = spark.range(60_000).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("segment_index"), F.lit("some words to pack into chunks here").alias("text"))
    began = time.time()
    assert semantic.chunk_assignment(long).agg(F.max("chunk_no")).first()[0] == 60_000 * 7 // 224 - 1 + (60_000 * 7 % 224 > 0)
    assert time.time() - began < 30


def test_lists_and_overview(spark):
    notes = spark.createDataFrame([(1, 5, "x"), (2, 7, "y")], "note_id int, updated_at int, body string")
    parts = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "note_id int, ordinal int, segment_id string")
    tags = spark.createDataFrame([(1, "Zeta"), (1, "alpha")], "note_id int, tag string")
    rows = {r["note_id"]: r for r in research.with_lists(notes, parts, tags, tags.limit(0).withColumnRenamed("tag", "collection")).collect()}
    assert (rows[1]["segment_ids"], rows[1]["tags"], rows[1]["collections"], rows[2]["tags"]) == (["a", "b"], ["alpha", "Zeta"], [], [])
    flat = spark.createDataFrame([(1, 5, "x", "t", "c"), (1, 5, "x", "u", "c"), (2, 7, "y", "t", None)], "note_id int, updated_at int, body string, tag string, collection string")
    view = research.overview(flat)
    assert [r["note_id"] for r in view["notes"].collect()] == [2, 1]
    assert [(r["tag"], r["usage_count"]) for r in view["tags"].collect()] == [("t", 2), ("u", 1)]
    assert [r["collection"] for r in view["collections"].collect()] == ["c"]


def test_the_first_spelling_counts(spark):
    names = spark.createDataFrame([(2, "harbour"), (1, "Harbour"), (3, "pier")], "n int, name string")
    known = spark.createDataFrame([("PIER",)], "tag string")
    first = research.get_or_create(known, spark.createDataFrame([(2, "Harbour"), (1, "harbour"), (3, "pier")], names.schema), "tag_id", "tag", "name", "n").collect()
    assert [r["tag"] for r in first] == ["harbour"]


def test_span_violations(spark):
    rows = spark.createDataFrame([("d", "s0", "abcdef", "en"), ("d", "s1", "abc", None)], "document_id string, segment_id string, text string, language string")
    spans = spark.createDataFrame([("d", "s0", 0, 4, "en"), ("d", "s0", 3, 9, "fr"), ("d", "s1", 0, 2, "fr"), ("d", "s1", 2, 3, "en")], "document_id string, segment_id string, start_char int, end_char int, language string")
    assert sorted((r["segment_id"], r["problem"]) for r in validation.span_violations(spans, rows).collect()) == [("s0", "beyond"), ("s0", "language"), ("s0", "overlap")]
