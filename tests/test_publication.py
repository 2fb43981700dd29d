"""Publication of a set of files: all or none, over failures at each step, names taken meanwhile and foreign files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.sources import generations, publication

SCHEMA = "file_id long, stem string, extension string, content string, document_id string, canonical_sha256 string"
FILES = [(1, "talk", "srt", "één\n\n", "d1", "g"), (2, "talk", "srt", "two\r\nlines\n", "d2", "g"), (3, "Talk", "txt", "\n", "d3", "g"), (4, "other", "", "x\n", "d4", "g")]


def listing(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if p.is_file()}


def staged(folder):
    return [p.name for p in folder.iterdir() if p.name.startswith(publication.STAGED)]


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "out"
    where.mkdir()
    (where / "TALK.srt").write_bytes(b"mine")
    return where


def test_whole_set_under_free_names(spark, folder):
    made = publication.publish(spark, spark.createDataFrame(FILES, SCHEMA), f"file://{folder}").orderBy("file_id").collect()
    assert [(r["file_id"], r["file_name"], r["n_bytes"]) for r in made] == [(1, "talk-2.srt", 7), (2, "talk-3.srt", 11), (3, "Talk.txt", 1), (4, "other", 2)]
    assert listing(folder) == {"TALK.srt": b"mine", "talk-2.srt": "één\n\n".encode(), "talk-3.srt": b"two\r\nlines\n", "Talk.txt": b"\n", "other": b"x\n"}
    assert not staged(folder)


@pytest.mark.parametrize("nth", [1, 2, 3, 4])
def test_failure_of_any_file_leaves_the_folder_as_it_was(spark, folder, monkeypatch, nth):
    real, calls = generations.put_new, []

    def put(*args):
        calls.append(1)
        if len(calls) == nth:
            raise OSError("disk full")
        real(*args)

    monkeypatch.setattr(generations, "put_new", put)
    with pytest.raises(OSError, match="disk full"):
        publication.publish(spark, spark.createDataFrame(FILES, SCHEMA), f"file://{folder}")
    assert listing(folder) == {"TALK.srt": b"mine"} and not staged(folder)


def test_a_name_that_is_taken_meanwhile_is_given_again(spark, folder, monkeypatch):
    real, calls = generations.put_new, []

    def put(session, draft, target):
        calls.append(1)
        if len(calls) == 3:
            (folder / target.rsplit("/", 1)[1]).write_bytes(b"another's")
        real(session, draft, target)

    monkeypatch.setattr(generations, "put_new", put)
    publication.publish(spark, spark.createDataFrame(FILES, SCHEMA), f"file://{folder}")
    found = listing(folder)
    assert list(found.values()).count(b"another's") == 1 and len(found) == 6 and not staged(folder)
    assert sorted(v for v in found.values() if v not in (b"mine", b"another's")) == sorted(f[3].encode() for f in FILES)


def test_a_publication_that_was_cut_off_is_undone(spark, folder, monkeypatch):
    real, calls = generations.put_new, []

    def put(*args):
        calls.append(1)
        if len(calls) == 3:
            raise SystemExit("killed")
        real(*args)

    with monkeypatch.context() as m:
        m.setattr(generations, "put_new", put)
        m.setattr(publication, "undo", lambda *a: None)
        with pytest.raises(SystemExit):
            publication.publish(spark, spark.createDataFrame(FILES, SCHEMA), f"file://{folder}")
    assert len(listing(folder)) == 3 and len(staged(folder)) == 1
    (folder / "Talk.txt").unlink(missing_ok=True)
    (folder / "Talk.txt").write_bytes(b"another's of that name")
    assert publication.recover(spark, f"file://{folder}") == []  # too young
    assert len(publication.recover(spark, f"file://{folder}", older=0)) == 1
    assert listing(folder) == {"TALK.srt": b"mine", "Talk.txt": b"another's of that name"} and not staged(folder)


@pytest.mark.parametrize("bad", [(9, "a", "txt", "no line end", "d", "g"), (9, "a/b", "txt", "\n", "d", "g"), (9, None, "txt", "\n", "d", "g"), (9, "a", "txt", None, "d", "g"), (None, "a", "txt", "\n", "d", "g"), (1, "a", "txt", "\n", "d", "g"), (9, ".hidden", "txt", "\n", "d", "g")])
def test_what_cannot_be_published_is_refused(spark, folder, bad):
    with pytest.raises(ValueError):
        publication.publish(spark, spark.createDataFrame([*FILES, bad], SCHEMA), f"file://{folder}")
    assert listing(folder) == {"TALK.srt": b"mine"} and not staged(folder)


def test_stale_generations_missing_folders_and_no_files(spark, folder):
    files = spark.createDataFrame(FILES, SCHEMA)
    now = spark.createDataFrame([("d1", "g"), ("d2", "h"), ("d3", "g"), ("d4", "g")], "document_id string, canonical_sha256 string")
    with pytest.raises(publication.Stale, match="file 2"):
        publication.publish(spark, files, f"file://{folder}", now)
    with pytest.raises(ValueError, match="not a folder"):
        publication.publish(spark, files, f"file://{folder}/missing")
    assert publication.publish(spark, files.limit(0), f"file://{folder}").count() == 0
    assert publication.publish(spark, files.filter("file_id <> 2"), f"file://{folder}", now).count() == 3


def test_more_files_of_a_stem_than_names_are_tried(spark, folder):
    """Numbers go on beyond those tried by default where none is given as the last; names that are taken, also in another way of cutting them, are passed over."""
    (folder / "talk-7.srt").write_bytes(b"mine too")
    files = spark.range(1, 1206).select(F.col("id").alias("file_id"), F.when(F.col("id") == 1205, "Talk-9").otherwise("talk").alias("stem"), F.lit("srt").alias("extension"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("content"))
    with pytest.raises(ValueError, match="free name"):
        publication.publish(spark, files, f"file://{folder}")
    publication.publish(spark, files, f"file://{folder}", last=None)
    free = [f"talk-{k}.srt" for k in range(2, 1300) if k not in (7, 9)]
    wanted = dict(zip(free, [f"{k}\n".encode() for k in range(1, 1205)], strict=False))
    assert listing(folder) == wanted | {"TALK.srt": b"mine", "talk-7.srt": b"mine too", "Talk-9.srt": b"1205\n"}


def test_calls_of_the_driver_do_not_grow_with_the_files(spark, folder, monkeypatch):
    real, calls = generations._path, []
    counted = lambda *args: calls.append(1) or real(*args)
    monkeypatch.setattr(generations, "_path", counted)
    monkeypatch.setattr(publication, "_path", counted)
    made = []
    for n in (3, 30):
        files = spark.range(n).select(F.col("id").alias("file_id"), F.concat(F.lit(f"{n}-"), "id").alias("stem"), F.lit("txt").alias("extension"), F.lit("x\n").alias("content"))
        calls.clear()
        publication.publish(spark, files, f"file://{folder}")
        made.append(len(calls))
    assert made[0] == made[1] and len(listing(folder)) == 34


def test_a_store_that_is_not_told_to_be_local(spark, folder, monkeypatch):
    """Spark's writer and the file system's own calls do the same."""
    monkeypatch.setattr(generations, "local_path", lambda name: None)
    publication.publish(spark, spark.createDataFrame(FILES, SCHEMA), f"file://{folder}")
    assert listing(folder) == {"TALK.srt": b"mine", "talk-2.srt": "één\n\n".encode(), "talk-3.srt": b"two\r\nlines\n", "Talk.txt": b"\n", "other": b"x\n"}
    assert not staged(folder)


def test_contents_are_made_once(spark, folder):
    made = spark.sparkContext.accumulator(0)

    def body(key):
        made.add(1)
        return f"{key}\n"

    files = spark.range(20).select(F.col("id").alias("file_id"), F.concat(F.lit("t"), "id").alias("stem"), F.lit("txt").alias("extension"), F.udf(body, "string")("id").alias("content"))
    publication.publish(spark, files, f"file://{folder}")
    assert made.value == 20 and len(listing(folder)) == 21


def test_published_files_are_read_back(spark, folder, monkeypatch):
    """Each file once, however many cores there are; hidden ones and folders are not its contents. The driver gets no list."""
    (folder / ".hidden").write_bytes(b"h")
    (folder / "_hidden").write_bytes(b"h")
    (folder / "inner").mkdir()
    publication.publish(spark, spark.createDataFrame([*FILES, (5, "a b%20ü", "txt", "x" * 50 + "\n", "d5", "g")], SCHEMA), f"file://{folder}")
    wanted = sorted((k, v) for k, v in listing(folder).items() if k[0] not in "._")
    monkeypatch.setattr(publication, "READ_BYTES", 8)
    there = publication.contents(spark, f"file://{folder}")
    assert sorted((r["file_name"], bytes(r["content"])) for r in there.collect()) == wanted and len(wanted) == 6
    assert not there.inputFiles()
    monkeypatch.setattr(publication.generations, "local_path", lambda name: None)
    assert sorted((r["file_name"], bytes(r["content"])) for r in publication.contents(spark, f"file://{folder}").collect()) == wanted


def test_a_path_of_the_default_store_is_a_local_one(spark, folder, monkeypatch):
    monkeypatch.setattr(publication, "_write_store", None)
    publication.publish(spark, spark.createDataFrame(FILES, SCHEMA), str(folder))
    assert len(listing(folder)) == 5 and publication.contents(spark, str(folder)).count() == 5
