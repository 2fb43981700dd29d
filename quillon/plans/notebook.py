"""Notes as one state of several tables: a batch of new notes with their segments, tags, collections and journal rows is one commit.

The journal's last sequence is the commit's watermark, so a snapshot (:meth:`Notebook.snapshot`) gives the sequence and the tables from one pointer.
A commit adds the rows of its batch in files of their own, and never rewrites what is there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from quillon.functions import text as T
from quillon.operators.incremental import with_sequence
from quillon.sources import generations, shared

TABLES = {
    "notes": "note_id long, document_id string, canonical_sha256 string, body string, updated_at long, version int",
    "note_segments": "note_id long, ordinal int, segment_id string",
    "note_tags": "note_id long, tag string",
    "note_collections": "note_id long, collection string",
    "journal": "sequence_id long, note_id long, op string",
}
REQUEST = "note_id long, document_id string, canonical_sha256 string, body string, segment_ids array<string>, tags array<string>, collections array<string>, updated_at long"
CREATED, EXISTS, INVALID, REPEATED = "created", "exists", "invalid", "repeated"


def judged(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (see REQUEST) with outcome: "invalid" (no id, document or segment, a blank body, or a blank name), "exists", "repeated" (another request of the
    batch has the id and comes first, by time and content), else "created"."""
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    some_blank = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), blank)
    bad = F.col("note_id").isNull() | blank(F.col("document_id")) | blank(F.col("body")) | (F.size(F.coalesce("segment_ids", F.array().cast("array<string>"))) == 0)
    bad = bad | some_blank(F.col("segment_ids")) | some_blank(F.col("tags")) | some_blank(F.col("collections"))
    held = notes.select("note_id", F.lit(True).alias("_held"))
    content = F.xxhash64("document_id", "canonical_sha256", "body", "segment_ids", "tags", "collections")
    # Invalid requests stand in groups of their own, so that many without an id are not gathered.
    group = F.when(F.col("_bad"), F.xxhash64(F.lit(1), content, F.monotonically_increasing_id())).otherwise(F.col("note_id"))
    rows = requests.withColumn("_bad", bad).withColumn("_group", group).join(held, "note_id", "left")
    first = F.row_number().over(W.partitionBy("_bad", "_group").orderBy("updated_at", content))
    outcome = F.when(F.col("_bad"), INVALID).when(F.col("_held"), EXISTS).when(F.col("_n") > 1, REPEATED).otherwise(CREATED)
    return rows.withColumn("_n", first).withColumn("outcome", outcome).select(*requests.columns, "outcome")


def rows_of(created: DataFrame, after: int) -> dict[str, DataFrame]:
    """The rows that new notes add to each table; journal rows are numbered from ``after`` on, in the order of note ids."""
    names = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.strip))
    out = {
        "notes": created.withColumns({"body": T.strip(F.col("body")), "version": F.lit(1)}),
        "note_segments": created.select("note_id", F.posexplode("segment_ids").alias("ordinal", "segment_id")),
        "note_tags": created.select("note_id", F.explode(names(F.col("tags"))).alias("tag")),
        "note_collections": created.select("note_id", F.explode(names(F.col("collections"))).alias("collection")),
        "journal": with_sequence(created.select("note_id", F.lit("create").alias("op")), ["note_id"], after),
    }
    return {k: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[k])]) for k, df in out.items()}


@dataclass(frozen=True)
class Snapshot:
    """One state: ``sequence`` is the last journal row that ``tables`` hold."""

    sequence: int
    tables: dict[str, DataFrame]


class Notebook:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _tables(self, at: generations.Commit | None) -> dict[str, DataFrame]:
        schemas = {k: StructType.fromDDL(v) for k, v in TABLES.items()}
        return {k: at.read(self.spark, k, s) if at else self.spark.createDataFrame([], s) for k, s in schemas.items()}

    def snapshot(self) -> Snapshot:
        """The latest state; it stays readable, and the same, while others write."""
        at = generations.head(self.spark, self.root)
        return Snapshot(at.watermark if at else 0, self._tables(at))

    def judge(self, requests: DataFrame, base: generations.Commit | None) -> DataFrame:
        """``requests`` with their outcome on ``base``, written once to the shared folder: each table of the commit is made from these rows."""
        kept = shared.folder(self.spark, "judged")
        judged(self._tables(base)["notes"], requests).write.parquet(kept)
        return self.spark.read.parquet(kept)

    def prepare(self, requests: DataFrame, base: generations.Commit | None) -> dict:
        """What a commit of the valid requests on ``base`` adds; requests that are judged on it already are taken as they are."""
        rows = requests if "outcome" in requests.columns else self.judge(requests, base)
        created = rows.filter(F.col("outcome") == CREATED).drop("outcome")
        before = base.watermark if base else 0
        return {"watermark": before + created.count(), "add": rows_of(created, before)}

    def create(self, requests: DataFrame, attempts: int = 5) -> DataFrame:
        """Add the notes of a batch that can be, all in one commit, and return ``requests`` with their outcome. If another writer was faster the batch is judged again on what it
        left. ``requests`` is read once for each attempt."""
        seen = []

        def change(base):
            seen.append(self.judge(requests, base))
            return self.prepare(seen[-1], base)

        generations.transact(self.spark, self.root, change, attempts)
        return seen[-1]
