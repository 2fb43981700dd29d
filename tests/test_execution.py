"""Execution of plans: a stale token does nothing; killed after any action and run again, the end is the same."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import custody
from quillon.sources import execution, generations

SCOPES = ["canonical-transcript", "research-notes"]
TABLES = {"canonical-transcript": [("documents", "document_id"), ("segments", "document_id")], "research-note": [("notes", "note_id"), ("note_tags", "note_id")]}


class State:
    def __init__(self, spark, tmp_path):
        self.spark, self.files, self.root, self.log = spark, tmp_path / "library", f"file://{tmp_path}/state", f"file://{tmp_path}/log"
        self.files.mkdir()
        for d in ("a", "b"):
            (self.files / f"{d}.json").write_text(d)
            (self.files / f"{d}-job").mkdir()
            (self.files / f"{d}-job" / "part").write_text(d)
        frame = spark.createDataFrame
        tables = {
            "documents": frame([("a", "ga"), ("b", "gb")], "document_id string, canonical_sha256 string"), "segments": frame([("a", 0), ("a", 1), ("b", 0)], "document_id string, i int"),
            "notes": frame([(1, "a"), (2, "b"), (3, "a")], "note_id long, document_id string"), "note_tags": frame([(1, "t"), (2, "t"), (3, "u")], "note_id long, tag string"),
        }
        generations.commit(spark, self.root, None, 5, replace=tables)

    def plan(self):
        read = lambda n: generations.read(self.spark, self.root, n)
        doc = read("documents").filter("document_id = 'a'")
        saved = self.spark.createDataFrame([("s1", "a")], "saved_search_id string, document_id string")
        actions = custody.deletion_actions(doc, read("notes"), saved, SCOPES)
        token = custody.deletion_plans(actions, doc, SCOPES).first()
        path = F.when(F.col("target") == "canonical-transcript", F.concat(F.lit(f"file://{self.files}/"), "object_id", F.lit(".json"))).when(F.col("target") == "execution-state", F.concat(F.lit(f"file://{self.files}/"), "object_id", F.lit("-job")))
        return actions.filter("fate = 'action'").withColumn("path", path), token["confirmation_token"] if token else "none"

    def run(self, token):
        return execution.execute(self.spark, self.log, token, self.plan, self.root, TABLES, [f"file://{self.files}"])

    def seen(self):
        tables = {n: sorted(map(tuple, generations.read(self.spark, self.root, n).collect())) for n in ("documents", "segments", "notes", "note_tags")}
        return tables, sorted(p.name for p in self.files.iterdir())


END = ({"documents": [("b", "gb")], "segments": [("b", 0)], "notes": [(2, "b")], "note_tags": [(2, "t")]}, ["b-job", "b.json"])
LINES = [("canonical-transcript", "a", True), ("derived-artifacts", "a", None), ("execution-state", "a", True), ("library-view", "a", None), ("research-note", "1", None), ("research-note", "3", None)]


def lines(receipt):
    return sorted((r["target"], r["object_id"], r["existed"]) for r in receipt.collect())


def test_a_confirmed_plan_and_its_receipt(spark, tmp_path):
    state = State(spark, tmp_path)
    token = state.plan()[1]
    assert execution.receipt(spark, state.log, token) is None
    assert lines(state.run(token)) == LINES and state.seen() == END
    (state.files / "a.json").write_text("made anew")
    number = generations.head(spark, state.root).number
    assert lines(state.run(token)) == LINES  # done: nothing more happens
    assert generations.head(spark, state.root).number == number == 2 and (state.files / "a.json").exists()


def test_a_stale_token_does_nothing(spark, tmp_path):
    state = State(spark, tmp_path)
    token, before = state.plan()[1], state.seen()
    base = generations.head(spark, state.root)
    generations.commit(spark, state.root, base, 6, add={"notes": spark.createDataFrame([(9, "a")], "note_id long, document_id string")})
    for wrong in (token, "delete:a:made-up", ""):
        with pytest.raises(execution.Refused, match="changed"):
            state.run(wrong)
    after = state.seen()
    assert after[1] == before[1] and after[0]["documents"] == before[0]["documents"] and len(after[0]["notes"]) == 4


@pytest.mark.parametrize("step", ["record", "rows", "mark-1", "file-1", "file-2", "mark-2"])
def test_killed_at_any_step_and_run_again(spark, tmp_path, monkeypatch, step):
    state = State(spark, tmp_path)
    token = state.plan()[1]
    kind, _, nth = step.partition("-")
    calls = {"mark": 0, "file": 0}
    mark, path, record, transact = execution._mark, execution._path, execution._record, generations.transact

    def killed(*a, **k):
        raise SystemExit(step)

    def counted(name, real, fits=lambda *a: True):
        def call(*a):
            if fits(*a):
                calls[name] += 1
                if kind == name and calls[name] == int(nth):
                    killed()
            return real(*a)

        return call

    with monkeypatch.context() as m:
        m.setattr(execution, "_mark", counted("mark", mark))
        if kind == "record":
            m.setattr(execution, "_record", lambda *a: (record(*a), killed()))
        if kind == "rows":
            m.setattr(generations, "transact", lambda *a: (transact(*a), killed()))
        if kind == "file":
            started = lambda s, n: n.startswith(f"file://{state.files}") and calls["mark"] == 1
            m.setattr(execution, "_path", counted("file", path, started))
        with pytest.raises(SystemExit):
            state.run(token)
    assert execution.receipt(spark, state.log, token) is None
    assert lines(state.run(token)) == LINES and state.seen() == END


def test_paths_outside_are_refused_before_anything_goes(spark, tmp_path):
    state = State(spark, tmp_path)
    before, root = state.seen(), f"file://{state.files}"
    for bad in ("file:///etc/passwd", root, f"{root}/", f"{root}/../state", f"{root}-other/x", f"{root}/./a.json"):
        rows = spark.createDataFrame([("execution-state", "a", f"{root}/a.json"), ("execution-state", "b", bad)], "target string, object_id string, path string")
        with pytest.raises(execution.Refused, match="outside"):
            execution.execute(spark, state.log, bad, lambda rows=rows, bad=bad: (rows, bad), roots=[root])
    assert state.seen() == before


def test_retention_deletes_workspaces_and_tells_which_were_there(spark, tmp_path):
    state = State(spark, tmp_path)
    root = f"file://{state.files}"
    rows = spark.createDataFrame([("execution-state", "j1", f"{root}/a-job"), ("execution-state", "j2", f"{root}/gone-job"), ("execution-state", "j3", None)], "target string, object_id string, path string")
    done = execution.execute(spark, state.log, "retention:x", lambda: (rows, "retention:x"), roots=[root])
    assert lines(done) == [("execution-state", "j1", True), ("execution-state", "j2", False), ("execution-state", "j3", None)]
    assert sorted(p.name for p in state.files.iterdir()) == ["a.json", "b-job", "b.json"]
    empty = execution.execute(spark, state.log, "retention:none", lambda: (rows.limit(0), "retention:none"), roots=[root])
    assert empty.count() == 0
