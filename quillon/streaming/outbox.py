"""Change-log replay: the projection follows the authoritative state through the log of changed notes.

``replay`` is a Structured Streaming query over the log's files; ``catch_up`` takes the changes of a log table in batches of
a number of changes. Both write only the buckets of the projection that a batch touches, and rebuild it from a snapshot
where the log no longer has the next change."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import incremental
from quillon.operators.incremental import apply_changes
from quillon.sources import generations

LOG_SCHEMA = "sequence_id long, note_id long"
#: Buckets of a projection: a batch of 500 changes rewrites at most that many of them.
BUCKETS = 1024


@dataclass(frozen=True)
class Report:
    """What a catch-up did; sequences before and after, and that of the authority."""

    before: int
    after: int
    authority: int
    batches: int
    rebuilt: bool


def _apply(spark: SparkSession, root: str, changed: DataFrame, state: DataFrame, through: int, key: str, buckets: int) -> None:
    """Bring the notes of one batch to their present state. ``changed`` has at most one batch of rows."""
    ids = changed.select(key).distinct()
    touched = [r[0] for r in ids.select(generations.bucket_of(key, buckets)).distinct().collect()]  # at most `buckets` rows
    mine = lambda df: df.filter(generations.bucket_of(key, buckets).isin(touched))
    base = generations.read_buckets(spark, root, "projection", state.schema, touched) if generations.current(spark, root) else state.limit(0)
    generations.publish_buckets(spark, root, "projection", apply_changes(base, ids, mine(state), key), key, buckets, through, touched)


def apply_batch(spark: SparkSession, root: str, state: Callable[[], DataFrame], key: str = "note_id", buckets: int = BUCKETS, authority: Callable[[], int] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: publish the projection after one batch, unless its changes are known already.

    A batch that does not go on where the projection stands is a gap: the projection is made anew from the state. ``authority``
    gives the state's own sequence, read before the state; without it the batch's last one stands for it."""

    def run(batch: DataFrame, _: int) -> None:
        last = batch.agg(F.max("sequence_id")).first()[0]
        now = generations.current(spark, root)
        seen = now[1] if now else 0
        if authority is not None:
            _check(seen, authority())
        if last is None or last <= seen:
            return
        changed = batch.filter(F.col("sequence_id") > seen)
        if incremental.has_gap(changed, seen, last):
            rebuild(spark, root, state(), max(last, authority() if authority else last), key, buckets)
        else:
            _apply(spark, root, changed, state(), last, key, buckets)

    return run


def _check(projected: int, authority: int) -> None:
    if projected > authority:
        raise ValueError(f"the projection ({projected}) is ahead of its authority ({authority})")


def replay(
    spark: SparkSession, log_path: str, root: str, checkpoint: str, state: Callable[[], DataFrame], key: str = "note_id", files_per_batch: int = 1, schema: str = LOG_SCHEMA,
    buckets: int = BUCKETS, authority: Callable[[], int] | None = None,
) -> None:
    """Apply all files of the log that are not applied yet, then stop. ``state`` gives the authoritative records."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
    query = stream.writeStream.foreachBatch(apply_batch(spark, root, state, key, buckets, authority)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def catch_up(
    spark: SparkSession, root: str, log: Callable[[], DataFrame], state: Callable[[], DataFrame], authority: Callable[[], int], key: str = "note_id",
    size: int = incremental.BATCH, most: int = incremental.BATCHES, buckets: int = BUCKETS,
) -> Report:
    """Apply a log table's changes past the watermark, ``size`` at a time in at most ``most`` batches.

    A projection ahead of its authority is an error. Where the log lacks the next change, also when it is empty, the
    projection is rebuilt. ``authority`` is the present sequence of the state, and is read before the state."""
    now = generations.current(spark, root)
    before = now[1] if now else 0
    goal = authority()
    _check(before, goal)
    if before == goal:
        return Report(before, before, goal, 0, False)
    if incremental.has_gap(log(), before, goal):
        rebuild(spark, root, state(), goal, key, buckets)
        return Report(before, goal, goal, 1, True)
    projected = before
    for done in range(most):
        batch = incremental.batch_after(log(), projected, size)
        last = batch.agg(F.max("sequence_id")).first()[0]
        if last is None:
            goal = authority()
            if projected == goal:
                return Report(before, projected, goal, done, False)
            rebuild(spark, root, state(), goal, key, buckets)
            return Report(before, goal, goal, done + 1, True)
        _apply(spark, root, batch, state(), last, key, buckets)
        projected = last
    raise RuntimeError(f"the projection did not catch up in {most} batches")


def read(spark: SparkSession, root: str, state: DataFrame) -> DataFrame:
    """The projection as it stands; ``state`` gives its columns."""
    return generations.read_buckets(spark, root, "projection", state.schema)


def rebuild(spark: SparkSession, root: str, state: DataFrame, through: int, key: str = "note_id", buckets: int = BUCKETS) -> str:
    """The projection anew from a snapshot, when the log has a gap."""
    return generations.publish_buckets(spark, root, "projection", state, key, buckets, through)
