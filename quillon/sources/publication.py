"""Publication of text files into a folder that others use too: all of a set, or none.

Spark's tasks write the files beside their place, in a staged folder of the destination, with a manifest. Then each file gets its name, only if
nobody has taken it meanwhile; if one cannot, those before it are taken back. A publication that was cut off is undone from its manifest."""

from __future__ import annotations

import hashlib
import os
import shutil
import time
import uuid
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.changes import LAST_SUFFIX, free_names
from quillon.sources import generations, shared
from quillon.sources.generations import _path

#: Names of staged folders begin with this, and hold a file of this name once all is published.
STAGED, DONE = ".staged-", "_published"
#: Contents of about so many bytes are read at a time.
READ_BYTES = 4 << 20


class Stale(ValueError):
    """A document has changed since its export was asked for."""


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, files = _path(spark, folder)
    return sorted(entry.getPath().getName() for entry in files.listStatus(path))


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _qualified(spark: SparkSession, folder: str) -> str:
    """With the scheme of its store, which a path in the default one lacks."""
    path, files = _path(spark, folder)
    return files.makeQualified(path).toString()


def _drop(spark: SparkSession, staged: str) -> None:
    """Delete a staged folder; what has a name stays."""
    if own := generations.local_path(staged):
        shutil.rmtree(own, ignore_errors=True)
    path, files = _path(spark, staged)
    files.delete(path, True)


def _staged_files(spark: SparkSession, staged: str) -> DataFrame:
    """The manifest with what tasks have written for each id: the number of files, and path and size of the first."""
    counts = spark.read.parquet(f"{staged}/written").groupBy("file_id").agg(F.count(F.lit(1)).alias("n_staged"), F.min_by("path", "path").alias("path"), F.min_by("size", "path").alias("size"))
    return spark.read.parquet(f"{staged}/manifest").select("file_id", "file_name", "n_bytes").join(counts, "file_id", "left").fillna(0, ["n_staged"])


def _write_batches(folder: str):
    def run(batches):
        own = f"{folder}/{uuid.uuid4().hex}"  # of this run of a task: tasks don't wait for each other's folder, and what one leaves that fails is in no table
        os.makedirs(own)
        place = 0
        for batch in batches:
            paths, told = [], []
            for content in batch.column(3):
                body = content.as_buffer() if content.is_valid else None
                if body is None:
                    paths.append(None)
                    told.append((None, None, None, False))
                    continue
                path, place = f"{own}/{place}", place + 1
                with open(path, "xb") as out:
                    out.write(body)
                paths.append(f"file://{path}")
                told.append((os.path.getsize(path), len(body), hashlib.sha256(body).hexdigest(), len(body) > 0 and body[-1] == 10))
            columns = [pa.array(c, t) for c, t in zip(zip(*told, strict=True) if told else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(paths, pa.string()), *columns], names=["file_id", "stem", "extension", "path", "size", "n_bytes", "sha256", "_ended"])

    return run


def _write_local(spark: SparkSession, files: DataFrame, staged: str) -> DataFrame:
    """Let tasks write each content to a file of its own, and a table (file_id, stem, extension, path, size, n_bytes, sha256, _ended) of what is written. Contents are made once.

    Spark's writer makes a folder for each file, and starts a process for the mode of each."""
    # As many tasks as can run take part, however short the texts are.
    rows = files.select("file_id", "stem", "extension", F.col("content").cast("binary").alias("content")).repartition(_tasks(spark), "file_id")
    told = rows.mapInArrow(_write_batches(generations.local_path(f"{staged}/files")), "file_id long, stem string, extension string, path string, size long, n_bytes long, sha256 string, _ended boolean")
    told.write.parquet(f"{staged}/written")
    return spark.read.parquet(f"{staged}/written")


def _write_store(spark: SparkSession, files: DataFrame, staged: str) -> None:
    """The same by Spark's writer, for any store; the table has file_id, path and size. Its folders are listed by Spark's tasks."""
    body = F.expr("substring(content, 1, length(content) - 1)")  # the writer ends each line
    rows = files.repartition(_tasks(spark), "file_id")
    rows.select(F.col("file_id").alias("_file"), body.alias("value")).write.partitionBy("_file").option("lineSep", "\n").text(f"{staged}/files")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{staged}/files")
    written = found.select(F.regexp_extract("path", "/_file=(-?[0-9]+)/[^/]*$", 1).cast("long").alias("file_id"), "path", F.col("length").alias("size"))
    written.write.parquet(f"{staged}/written")


def stage(spark: SparkSession, files: DataFrame, destination: str, last: int | None = LAST_SUFFIX) -> str:
    """Write ``files`` (file_id, stem, extension, content) and their manifest into a staged folder, and return it. Names are free ones of the destination, numbered up to ``last``.

    Every id is unique, every content ends with a line end (as all exports do), names are plain ones. ``files`` must be the same each time it is read."""
    destination = _qualified(spark, destination)
    staged = f"{destination}/{STAGED}{uuid.uuid4().hex}"
    taken = spark.createDataFrame([(n,) for n in _names(spark, destination) if not n.startswith(STAGED)], "file_name string")
    files = files.withColumn("file_id", F.col("file_id").cast("long"))
    fine = F.col("file_id").isNotNull() & F.col("_ended") & F.coalesce(~F.col("file_name").rlike(r"[/\\]|^\.|^$"), F.lit(False))
    local = generations.local_path(staged)
    try:
        if local:
            told = _write_local(spark, files, staged)
        else:
            told = files.select("file_id", "stem", "extension", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), F.coalesce(F.endswith("content", F.lit("\n")), F.lit(False)).alias("_ended"))
        named = free_names(told.select("file_id", "stem", "extension"), taken, "file_id", last).select("file_id", "file_name")
        manifest = told.select("file_id", "n_bytes", "sha256", "_ended").join(named, "file_id", "left")
        manifest.withColumn("_fine", fine).write.parquet(f"{staged}/manifest")
        written = spark.read.parquet(f"{staged}/manifest")
        if bad := written.filter("NOT _fine").first():
            raise ValueError(f"file {bad['file_id']} has no plain or free name, no id, or no line end")
        if twice := written.groupBy("file_id").count().filter("count > 1").first():
            raise ValueError(f"two files have the id {twice[0]}")
        if not local:
            _write_store(spark, files, staged)
    except BaseException:
        _drop(spark, staged)  # nothing has a name yet
        raise
    return staged


def place(spark: SparkSession, staged: str) -> None:
    """Give every staged file its name. A :class:`~quillon.sources.generations.Conflict` if one is taken; then, as after any failure, none has it."""
    destination = staged.rsplit("/", 1)[0]
    try:
        for row in _staged_files(spark, staged).toLocalIterator(prefetchPartitions=True):
            if row["n_staged"] != 1:
                raise RuntimeError(f"file {row['file_id']} was staged {row['n_staged']} times")
            if row["size"] != row["n_bytes"]:
                raise RuntimeError(f"file {row['file_id']} has {row['size']} bytes, not {row['n_bytes']}")
            generations.put_new(spark, row["path"], f"{destination}/{row['file_name']}")
        path, files = _path(spark, f"{staged}/{DONE}")
        files.create(path, False).close()
    except BaseException:
        undo(spark, staged)
        raise


def undo(spark: SparkSession, staged: str) -> None:
    """Take back what a staged folder has published, and delete it. Files of others stay, also one that has a name of the manifest. What is published whole only loses its staged folder."""
    destination = staged.rsplit("/", 1)[0]
    done, files = _path(spark, f"{staged}/{DONE}")
    manifest, _ = _path(spark, f"{staged}/manifest/_SUCCESS")
    if not files.exists(done) and files.exists(manifest) and files.exists(_path(spark, f"{staged}/written/_SUCCESS")[0]):
        for row in _staged_files(spark, staged).toLocalIterator():
            if row["path"] and generations.is_own(spark, row["path"], f"{destination}/{row['file_name']}"):
                files.delete(_path(spark, f"{destination}/{row['file_name']}")[0], False)
    _drop(spark, staged)


def recover(spark: SparkSession, destination: str, older: float = 3600) -> list[str]:
    """Undo publications that were cut off: staged folders that nobody has changed for ``older`` seconds. Returns their names."""
    path, files = _path(spark, destination)
    now = time.time() * 1000
    left = [e.getPath().getName() for e in files.listStatus(path) if e.getPath().getName().startswith(STAGED) and now - e.getModificationTime() >= older * 1000]
    for name in sorted(left):
        undo(spark, f"{destination}/{name}")
    return sorted(left)


def publish(spark: SparkSession, files: DataFrame, destination: str, current: DataFrame | None = None, attempts: int = 3, last: int | None = LAST_SUFFIX) -> DataFrame:
    """Publish ``files`` (file_id, stem, extension, content) in a folder that exists, all or none, and return the manifest: file_id, file_name, n_bytes, sha256.

    With ``current`` (document_id, canonical_sha256) the files have these columns too, and are refused as :class:`Stale` if one is of another generation.
    If a name is taken while files are placed, the set is named again, up to ``attempts`` times. ``last`` is the highest number in a name (none: as high as needed). The names are given one by one by the driver, which holds one at a time."""
    path, there = _path(spark, destination)
    if not there.exists(path) or not there.getFileStatus(path).isDirectory():
        raise ValueError(f"{destination} is not a folder")
    if current is not None and (old := files.join(current, ["document_id", "canonical_sha256"], "left_anti").select("file_id").first()):
        raise Stale(f"file {old[0]} is of another generation of its document")
    for left in range(attempts - 1, -1, -1):
        staged = stage(spark, files, destination, last)
        manifest = spark.read.parquet(f"{staged}/manifest").select("file_id", "file_name", "n_bytes", "sha256")
        try:
            place(spark, staged)
        except generations.Conflict:
            if not left:
                raise
            continue
        kept = shared.folder(spark, "published")
        manifest.write.parquet(kept)
        _drop(spark, staged)
        return spark.read.parquet(kept)
    raise ValueError("attempts must be 1 or more")


def _list_names(folder: str):
    def run(batches):
        for _ in batches:
            pass
        with os.scandir(folder) as entries:
            names = (e.name for e in entries if e.name[0] not in "._" and e.is_file())
            while some := list(islice(names, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["file_name"])

    return run


def _read_batches(folder: str):
    def run(batches):
        for batch in batches:
            names, bodies, size = [], [], 0
            for name in batch.column(0).to_pylist():
                with open(f"{folder}/{name}", "rb") as file:
                    bodies.append(file.read())
                names.append(name)
                size += len(bodies[-1])
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["file_name", "content"])
                    names, bodies, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["file_name", "content"])

    return run


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """file_name and content (binary) of all files of a folder but hidden ones (names with ``.`` or ``_`` in front).

    Of local files one task lists the names, as they are one folder's, and all tasks open them: Spark's reader has them listed by the driver, with a look at each, takes a few to a task, and milliseconds to open
    one. In any other store it is Spark's reader."""
    folder = _qualified(spark, folder)
    if own := generations.local_path(folder):
        names = spark.range(0, 1, 1, 1).mapInArrow(_list_names(own), "file_name string")
        return names.repartition(_tasks(spark), "file_name").mapInArrow(_read_batches(own), "file_name string, content binary")
    read = spark.read.format("binaryFile").load(folder)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
