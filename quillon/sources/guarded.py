"""Files read under guard: stat, digest in blocks, stat again. A file that changes meanwhile is told as a row, not read as if it were whole.

``guarded`` is a Python data source for ``spark.read`` and ``spark.readStream``. It lists one folder (on the driver, as Spark's own file sources do), deals the files to
tasks by size, and reads each in blocks, so that a file of any size takes a block of memory. As a stream its offset is a digest of the listing: nothing runs while
that stays the same, and a batch reads only files whose size or time differ from what the last published state knows, and tells those that are gone.

Paths are read with pyarrow's file systems (local, S3, HDFS, GCS)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillon.sources import generations

SCHEMA = "path string, size long, modified_ns long, sha256 string, problem string, content binary"
CHANGED, UNREADABLE, MISSING, TOO_LARGE = "changed while reading", "unreadable", "missing", "too large"
#: Bytes of a block, and of the files that one task reads, unless one alone is larger.
BLOCK, TASK = 1 << 20, 128 << 20


@dataclass(frozen=True)
class Listed:
    path: str
    size: int
    modified_ns: int


class Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _stat(store: fs.FileSystem, path: str) -> tuple[int, int] | None:
    found = store.get_file_info(path)
    return (found.size, found.mtime_ns) if found.type == fs.FileType.File else None


def blocks(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    with store.open_input_stream(path) as f:
        while block := f.read(BLOCK):
            yield block


def digest(path: str, keep: int = 0) -> tuple:
    """A row of SCHEMA for one file. Its content stays where ``keep`` bytes are enough for it, else (with ``keep``) it is "too large". A file whose size or time
    differ after the reading, or that had another number of bytes, is "changed while reading" and has no digest."""
    store, inner = _opened(path)
    before = _stat(store, inner)
    if before is None:
        return path, None, None, None, MISSING, None
    found, held, n = hashlib.sha256(), [], 0
    try:
        for block in blocks(store, inner):
            found.update(block)
            n += len(block)
            if before[0] <= keep and n <= keep:
                held.append(block)
    except OSError:
        after = _stat(store, inner)
        return path, *before, None, CHANGED if after is None or after != before else UNREADABLE, None
    if _stat(store, inner) != before or n != before[0]:
        return path, *before, None, CHANGED, None
    return path, *before, found.hexdigest(), TOO_LARGE if keep and n > keep else None, b"".join(held) if 0 <= n <= keep and keep else None


def listing(folder: str, suffix: str = "") -> list[Listed]:
    """The folder's own files in the order of their names; hidden ones (. or _) are left out. A missing folder is an empty one."""
    store, inner = _opened(folder)
    found = store.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=True))
    at = folder.rstrip("/")
    rows = [Listed(f"{at}/{x.base_name}", x.size, x.mtime_ns) for x in found if x.type == fs.FileType.File and x.base_name.endswith(suffix) and x.base_name[0] not in "._"]
    return sorted(rows, key=lambda x: x.path)


def _dealt(files: list[Listed]) -> list[Part]:
    """Files in parts of TASK bytes or one file."""
    parts, held, size = [], [], 0
    for x in files:
        if held and size + x.size > TASK:
            parts.append(Part(held))
            held, size = [], 0
        held.append(x.path)
        size += x.size + BLOCK
    return [*parts, Part(held)] if held else parts


def _rows(part: Part, keep: int) -> Iterator[pa.RecordBatch]:
    names = ["path", "size", "modified_ns", "sha256", "problem", "content"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    for path in part.paths:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(digest(path, keep), kinds, strict=True)], names=names)


class Guarded(DataSource):
    """Options: path (a folder), suffix, keep (bytes up to which contents are returned, 0: none), and, for a stream, state (the root of :func:`refresh`)."""

    @classmethod
    def name(cls) -> str:
        return "guarded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GuardedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GuardedStream(dict(self.options))


class GuardedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.suffix, self.keep = options["path"], options.get("suffix", ""), int(options.get("keep", 0))

    def partitions(self) -> list[Part]:
        return _dealt(listing(self.folder, self.suffix)) or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return _rows(part, self.keep)


def _known(root: str) -> dict[str, tuple[int, int]]:
    """Path to size and time of the files that the latest published state holds."""
    import pyarrow.dataset as ds

    store, inner = _opened(root)
    pointers = [x.path for x in store.get_file_info(fs.FileSelector(f"{inner}/current", allow_not_found=True)) if x.base_name.endswith(".json") and x.base_name[:-5].isdigit()]
    if not pointers:
        return {}
    with store.open_input_stream(max(pointers)) as f:
        folders = json.loads(f.read())["tables"].get("files", [])
    found = [x.path for folder in folders for x in store.get_file_info(fs.FileSelector(f"{inner}/{folder}")) if x.base_name.endswith(".parquet")]
    rows = ds.dataset(found, filesystem=store, format="parquet").to_table(columns=["path", "size", "modified_ns"]).to_pydict() if found else {"path": []}
    return {p: (rows["size"][k], rows["modified_ns"][k]) for k, p in enumerate(rows["path"])}


class GuardedStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.suffix, self.keep, self.state = options["path"], options.get("suffix", ""), int(options.get("keep", 0)), options["state"]

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        lines = (f"{x.path}\0{x.size}\0{x.modified_ns}\n".encode() for x in listing(self.folder, self.suffix))
        found = hashlib.sha256()
        for line in lines:
            found.update(line)
        return {"listing": found.hexdigest()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        known, now = _known(self.state), listing(self.folder, self.suffix)
        gone = known.keys() - {x.path for x in now}
        return _dealt([x for x in now if known.get(x.path) != (x.size, x.modified_ns)] + [Listed(p, 0, 0) for p in sorted(gone)]) or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return _rows(part, self.keep)

    def commit(self, end: dict) -> None:
        pass


def read(spark: SparkSession, folder: str, suffix: str = "", keep: int = 0) -> DataFrame:
    """A row of SCHEMA for each file of the folder."""
    spark.dataSource.register(Guarded)
    return spark.read.format("guarded").options(suffix=suffix, keep=str(keep)).load(folder)


FILES = "path string, size long, modified_ns long, sha256 string"


def refresh(spark: SparkSession, folder: str, root: str, checkpoint: str, suffix: str = "") -> list[dict]:
    """Bring the published state of a folder (table "files" of ``root``, see FILES) up to date, in one run of a stream, and return what each batch did: a row per status with
    its number of files: "added", "updated" (another content), "touched" (another time, the same content), "removed" (the file is not there any more), and
    the problems of files that could not be read whole. A file with a problem keeps the row it had, and is looked at again with the next batch.

    A file whose size and time are known is not opened. A batch that is run again after a failure finds its own work done and changes nothing."""
    spark.dataSource.register(Guarded)
    reports: list[dict] = []

    def publish(batch: DataFrame, number: int) -> None:
        base = generations.head(spark, root)
        old = base.read(spark, "files") if base else spark.createDataFrame([], FILES)
        rows = batch.drop("content").persist()
        try:
            was = old.select("path", F.col("sha256").alias("_was"))
            status = F.when(F.col("problem") == MISSING, "removed").when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("_was").isNull(), "added")
            told = rows.join(was, "path", "left").select(status.when(F.col("_was") == F.col("sha256"), "touched").otherwise("updated").alias("status"))
            found = {r["status"]: r["n"] for r in told.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per status
            if not found:
                return
            settled = rows.filter((F.col("problem") == MISSING) | F.col("problem").isNull())
            files = old.join(settled.select("path"), "path", "left_anti").unionByName(settled.filter("problem IS NULL").select(*old.columns))
            generations.commit(spark, root, base, number, replace={"files": files})
            reports.append(found)
        finally:
            rows.unpersist()

    stream = spark.readStream.format("guarded").options(suffix=suffix, state=root).load(folder)
    running = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return reports


def integrity(index: DataFrame, seen: DataFrame) -> DataFrame:
    """``index`` (document_id, source_path, source_sha256) with integrity: "matches", "changed", "missing" or "unreadable", from rows of :func:`read`. A file that changed while it was read
    is unreadable: it was not read whole."""
    found = seen.select(F.col("path").alias("source_path"), F.col("sha256").alias("_h"), F.coalesce("problem", F.lit("")).alias("_p"))
    state = F.when(F.col("_p").isNull() | (F.col("_p") == MISSING), "missing").when(F.col("_h").isNull(), "unreadable").when(F.col("_h") == F.col("source_sha256"), "matches").otherwise("changed")
    return index.join(found, "source_path", "left").withColumn("integrity", state).drop("_h", "_p")
