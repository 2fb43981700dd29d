from __future__ import annotations

import hashlib
import os
import resource

from quillon.sources import canonical, generations, guarded


def rows_of(df):
    return {os.path.basename(r["path"]): r for r in df.collect()}


def test_files_are_digested_with_their_contents(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"one")
    (tmp_path / "b.json").write_bytes(b"x" * 50)
    (tmp_path / "c.txt").write_bytes(b"other")
    (tmp_path / ".d.json").write_bytes(b"hidden")
    (tmp_path / "e").mkdir()
    found = rows_of(guarded.read(spark, f"file://{tmp_path}", ".json", keep=10))
    assert set(found) == {"a.json", "b.json"}
    assert (found["a.json"]["sha256"], bytes(found["a.json"]["content"]), found["a.json"]["problem"], found["a.json"]["size"]) == (hashlib.sha256(b"one").hexdigest(), b"one", None, 3)
    assert (found["b.json"]["sha256"], found["b.json"]["content"], found["b.json"]["problem"]) == (hashlib.sha256(b"x" * 50).hexdigest(), None, "too large")
    assert guarded.read(spark, f"file://{tmp_path}/nowhere").count() == 0


def test_a_file_that_changes_during_the_read_is_told(tmp_path, monkeypatch):
    plain, path = guarded.blocks, tmp_path / "a.json"

    def while_reading(act):
        def run(store, inner):
            for k, block in enumerate(plain(store, inner)):
                if k == 0:
                    act()
                yield block

        return run

    def longer():
        with path.open("ab") as f:
            f.write(b"more")

    cases = {"longer": longer, "gone": lambda: path.unlink(), "touched": lambda: os.utime(path, ns=(1, 1)), "replaced": lambda: (path.with_suffix(".new").write_bytes(b"B" * (3 << 20)), os.replace(path.with_suffix(".new"), path))}
    for name, act in cases.items():
        path.write_bytes(b"A" * (3 << 20))
        monkeypatch.setattr(guarded, "blocks", while_reading(act))
        row = guarded.digest(str(path), keep=10 << 20)
        assert (row[3], row[4], row[5]) == (None, guarded.CHANGED, None), name
    monkeypatch.setattr(guarded, "blocks", plain)
    path.write_bytes(b"A")
    assert guarded.digest(str(path))[4] is None
    monkeypatch.setattr(guarded, "blocks", lambda *_: (_ for _ in ()).throw(OSError("no")))
    assert guarded.digest(str(path))[4] == guarded.UNREADABLE
    assert guarded.digest(str(tmp_path / "none"))[4] == guarded.MISSING


def test_a_large_file_takes_little_memory(tmp_path):
    path = tmp_path / "large.bin"
    with path.open("wb") as f:
        f.truncate(3 << 30)  # takes no disk
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    row = guarded.digest(str(path))
    assert row[1] == 3 << 30 and row[4] is None and len(row[3]) == 64
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kB


def test_a_second_run_reads_no_unchanged_file(spark, tmp_path):
    folder, root = tmp_path / "in", f"file://{tmp_path}/state"
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.json").write_text(f"text {k}")
    run = lambda: guarded.refresh(spark, f"file://{folder}", root, f"file://{tmp_path}/checkpoint", ".json")
    assert run() == [{"added": 4}]
    for k in range(4):  # what is read now would be unreadable or another content
        stat = (folder / f"{k}.json").stat()
        (folder / f"{k}.json").write_text(f"TEXT {k}")
        os.utime(folder / f"{k}.json", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert run() == []  # the listing is the same: no batch
    (folder / "4.json").write_text("new")
    assert run() == [{"added": 1}]
    held = {os.path.basename(r["path"]): r["sha256"] for r in generations.read(spark, root, "files").collect()}
    assert held == {f"{k}.json": hashlib.sha256(f"text {k}".encode()).hexdigest() for k in range(4)} | {"4.json": hashlib.sha256(b"new").hexdigest()}
    (folder / "0.json").write_text("longer text")
    os.utime(folder / "4.json", ns=(5, 5))
    (folder / "1.json").unlink()
    assert run() == [{"updated": 1, "touched": 1, "removed": 1}]
    assert {os.path.basename(r["path"]) for r in generations.read(spark, root, "files").collect()} == {"0.json", "2.json", "3.json", "4.json"}


def test_scan_tells_files_that_are_too_large(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text("{}" + " " * 100)
    monkeypatch.setattr(canonical, "MAX_BYTES", 10)
    assert [r["problem"] for r in canonical.scan(spark, str(tmp_path)).collect()] == ["too large"]
