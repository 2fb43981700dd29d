from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from quillon.plans.notebook import REQUEST, Notebook
from quillon.sources import generations

KEYS = [f.split()[0] for f in REQUEST.split(", ")]


def request(note_id, body="b", document="d", segments=("s",), tags=("t",), collections=None, at=1):
    return (note_id, document, "g", body, list(segments), list(tags), collections, at)


def counts(snapshot):
    return {k: df.count() for k, df in snapshot.tables.items()}


def test_of_two_writers_one_is_refused(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    base = generations.commit(spark, root, None, 1, replace={"t": spark.range(1)})
    said, gate = [], threading.Barrier(2)

    def write(n):
        df = spark.range(n)
        gate.wait()
        try:
            generations.commit(spark, root, base, 2, replace={"t": df, "u": df})
            said.append(n)
        except generations.Conflict:
            said.append("conflict")

    threads = [threading.Thread(target=write, args=(n,)) for n in (10, 20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert said.count("conflict") == 1
    n = next(x for x in said if x != "conflict")
    assert generations.read(spark, root, "t").count() == generations.read(spark, root, "u").count() == n
    assert len(list((tmp_path / "r").iterdir())) == 3  # the refused writer's files are gone
    assert not [p for p in (tmp_path / "r" / "current").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_reader_holds_its_commit(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    first = generations.commit(spark, root, None, 1, replace={"t": spark.range(3)})
    second = generations.commit(spark, root, first, 2, add={"t": spark.range(2)})
    third = generations.commit(spark, root, second, 3, replace={"t": spark.range(1)})
    (tmp_path / "r" / "someone-elses").mkdir()
    assert [c.read(spark, "t").count() for c in (first, second, third)] == [3, 5, 1]
    assert generations.drop_superseded(spark, root, keep=1) == []  # all are young
    assert first.read(spark, "t").count() == 3
    gone = generations.drop_superseded(spark, root, keep=2, grace=0)
    assert gone == []  # the second still needs the first's files
    assert set(generations.drop_superseded(spark, root, keep=1, grace=0)) == {first.generation, second.generation}
    assert generations.read(spark, root, "t").count() == 1 and (tmp_path / "r" / "someone-elses").exists()
    with pytest.raises(generations.Conflict):
        generations.commit(spark, root, second, 4, replace={"t": spark.range(9)})
    with pytest.raises(ValueError, match="behind"):
        generations.commit(spark, root, third, 2, replace={"t": spark.range(9)})


def test_a_note_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    book = Notebook(spark, f"file://{tmp_path}/n")
    assert book.snapshot().sequence == 0 and set(counts(book.snapshot()).values()) == {0}
    rows = [request(1, tags=["a", " a ", "b"]), request(2, segments=["x", "y"], collections=["c"]), request(2, body="later", at=2), request(3, body=" "), request(4, tags=[""]), request(None), request(5, segments=[])]
    done = book.create(spark.createDataFrame(rows, REQUEST))
    assert sorted((r["note_id"] or 0, r["outcome"]) for r in done.collect()) == [(0, "invalid"), (1, "created"), (2, "created"), (2, "repeated"), (3, "invalid"), (4, "invalid"), (5, "invalid")]
    before = book.snapshot()
    assert before.sequence == 2 and counts(before) == {"notes": 2, "note_segments": 3, "note_tags": 3, "note_collections": 1, "journal": 2}
    bad = spark.createDataFrame([request(9)], REQUEST).withColumn("tags", F.transform("tags", lambda t: F.raise_error(F.concat(F.lit("no "), t)).cast("string")))
    with pytest.raises(Exception, match="no t"):
        book.create(bad)
    assert book.snapshot().sequence == 2 and counts(book.snapshot()) == counts(before)
    book.create(spark.createDataFrame([request(2), request(7)], REQUEST))
    after = book.snapshot()
    assert after.sequence == 3 and [tuple(r) for r in after.tables["journal"].orderBy("sequence_id").collect()] == [(1, 1, "create"), (2, 2, "create"), (3, 7, "create")]
    assert counts(before)["notes"] == 2  # the older snapshot is what it was


def test_a_batch_is_judged_again_after_a_conflict(spark, tmp_path, monkeypatch):
    book, other = Notebook(spark, f"file://{tmp_path}/n"), Notebook(spark, f"file://{tmp_path}/n")
    plain, asked = book.prepare, []

    def slow(requests, base):
        if not asked:
            other.create(spark.createDataFrame([request(1, body="other")], REQUEST))
        asked.append(base)
        return plain(requests, base)

    monkeypatch.setattr(book, "prepare", slow)
    done = book.create(spark.createDataFrame([request(1, body="mine"), request(2)], REQUEST))
    assert sorted((r["note_id"], r["outcome"]) for r in done.collect()) == [(1, "exists"), (2, "created")] and len(asked) == 2
    assert {r["note_id"]: r["body"] for r in book.snapshot().tables["notes"].collect()} == {1: "other", 2: "b"}
    assert book.snapshot().sequence == 2


def test_requests_are_read_once_for_a_commit(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([request(k) for k in range(1, 41)] + [request(1, at=2)], REQUEST)
    book = Notebook(spark, f"file://{tmp_path}/n")
    done = book.create(rows.mapInArrow(seen, REQUEST))
    assert done.filter("outcome = 'created'").count() == 40 and done.filter("outcome = 'repeated'").count() == 1
    assert counts(book.snapshot()) == {"notes": 40, "note_segments": 40, "note_tags": 40, "note_collections": 0, "journal": 40}
    assert read.value == 41
