"""Keeping derived tables up to date: refresh deltas, change logs, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.sources import shared

#: Changes in one batch of a replay, batches in one run, and changes kept when a log is compacted (fixed values).
BATCH, BATCHES, RETAIN = 500, 1000, 2048


def refresh_delta(existing: DataFrame, loaded: DataFrame, key: str = "document_id", content: list[str] = ("canonical_sha256",), touch: list[str] = ("modified_ns",)) -> DataFrame:
    """(key, status, semantic_dirty): added, updated, unchanged or removed. A change of ``touch`` columns alone is an update
    that leaves vectors valid."""
    old, new = existing.select(key, F.struct(*content).alias("_oc"), F.struct(*touch).alias("_ot")), loaded.select(key, F.struct(*content).alias("_nc"), F.struct(*touch).alias("_nt"))
    met = old.join(new, key, "full")
    same_content, same_touch = F.col("_oc").eqNullSafe(F.col("_nc")), F.col("_ot").eqNullSafe(F.col("_nt"))
    status = F.when(F.col("_oc").isNull(), "added").when(F.col("_nc").isNull(), "removed").when(same_content & same_touch, "unchanged").otherwise("updated")
    return met.select(key, status.alias("status"), (~same_content).alias("semantic_dirty"))


def to_hash(listing: DataFrame, known: DataFrame, verify: bool = False) -> DataFrame:
    """Files of a listing (path, size, modified_ns) whose content must be read: those that differ from what is known, or all."""
    if verify:
        return listing
    return listing.join(known.select("path", "size", "modified_ns"), ["path", "size", "modified_ns"], "left_anti")


def delta_problems(upserted: DataFrame, removed: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, problem) for what makes a delta invalid: an upsert or a removal that is listed twice ("duplicate upsert",
    "duplicate removal"), a blank or null key ("blank"), a key in both lists ("both"). Lists have a row per key."""
    rows = upserted.select(F.col(key), F.lit(1).alias("u"), F.lit(0).alias("r")).unionByName(removed.select(F.col(key), F.lit(0).alias("u"), F.lit(1).alias("r")))
    counts = rows.groupBy(key).agg(F.sum("u").alias("u"), F.sum("r").alias("r"))
    blank = F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == ""
    named = [(F.col("u") > 1, "duplicate upsert"), (F.col("r") > 1, "duplicate removal"), (blank, "blank"), ((F.col("u") > 0) & (F.col("r") > 0), "both")]
    return counts.select(key, F.explode(F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in named]))).alias("problem"))


def apply_delta(base: DataFrame, upserts: DataFrame, removals: DataFrame, key: str = "document_id", upserted: DataFrame | None = None) -> DataFrame:
    """``base`` without touched keys, and the upserts. An invalid delta (see :func:`delta_problems`) is an error.

    ``upserted`` lists the upserted keys where ``upserts`` has several rows for one, as segments of a document."""
    bad = delta_problems(upserts if upserted is None else upserted, removals, key).limit(5).collect()
    if bad:
        raise ValueError("invalid delta: " + ", ".join(f"{r[0]!r} ({r[1]})" for r in bad))
    touched = upserts.select(key).unionByName(removals.select(key)).distinct()
    return base.join(touched, key, "left_anti").unionByName(upserts)


def with_sequence(changes: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """``changes`` with sequence_id: 1, 2, ... after the last known one, in the order given, nulls last. Rows that the order leaves equal are numbered as they come.

    Numbers are dealt without one task that reads all: rows are ranged by order and written once, with their range and their place in it, to the shared folder; each range
    starts where those before it end. Ranges are cut by a sample, which another reading of ``changes`` would draw anew: both counts and places are those of the written rows."""
    spark, by = changes.sparkSession, [F.col(c).asc_nulls_last() for c in order]
    place = F.monotonically_increasing_id()
    written = shared.folder(spark, "sequence")
    changes.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_p": F.shiftright(place, 33), "_k": place.bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(written)
    rows = spark.read.parquet(written)
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(starts), "_p").withColumn("sequence_id", F.col("_k") + F.col("_before") + F.lit(after + 1)).drop("_p", "_k", "_before")


def batch_after(log: DataFrame, watermark: int, size: int = BATCH) -> DataFrame:
    """The next ``size`` changes after the watermark, in order."""
    if not 1 <= size <= 10_000:
        raise ValueError("size must be 1 to 10,000")
    return log.filter(F.col("sequence_id") > watermark).orderBy("sequence_id").limit(size)


def has_gap(log: DataFrame, watermark: int, current: int | None = None) -> bool:
    """Whether the log no longer has the change after the watermark, so that only a rebuild helps.

    ``current`` is the authority's sequence: when it is past the watermark and the log is empty, that is a gap too."""
    oldest = log.agg(F.min("sequence_id")).first()[0]
    if oldest is None:
        return current is not None and current > watermark
    return oldest > watermark + 1 and (current is None or current > watermark)


def compacted(log: DataFrame, through: int, retain: int = RETAIN) -> DataFrame:
    return log.filter(F.col("sequence_id") > through - retain)


def apply_changes(projection: DataFrame, changed: DataFrame, state: DataFrame, key: str = "note_id") -> DataFrame:
    """``projection`` after some changes: every changed key has its present state, or is gone if it has none."""
    ids = changed.select(key).distinct()
    return projection.join(ids, key, "left_anti").unionByName(state.join(ids, key, "left_semi").select(*projection.columns))


def status(log: DataFrame, projected_through: int | None) -> DataFrame:
    """One row: current_sequence, projected_through, behind."""
    now = F.coalesce(F.max("sequence_id"), F.lit(0)).cast("long")
    return log.agg(now.alias("current_sequence")).withColumn("projected_through", F.lit(projected_through).cast("long")).withColumn("behind", F.col("current_sequence") - F.coalesce("projected_through", F.lit(0)))


def candidate_union(strict: DataFrame, lenient: DataFrame, key: str = "path") -> DataFrame:
    """One row per key; what the strict source says about it wins."""
    both = strict.withColumn("strict", F.lit(True)).unionByName(lenient.withColumn("strict", F.lit(False)))
    return both.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("strict")))).filter("_n = 1").drop("_n")
