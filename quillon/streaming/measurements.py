"""What stages of work have done, as rows of a table: batch stages by ``DataFrame.observe``, streams by a query listener.

A row is one run of a stage or one batch of a stream: stage, started_at, seconds, failed, rows, media_seconds (of the recordings that it has worked through; null if
that was not asked for)."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ROW = "stage string, started_at timestamp, seconds double, failed boolean, rows long, media_seconds double"
#: Rows that are held before they are appended to the table.
HELD = 1000


class Span:
    """One run of a stage. What :meth:`run` sees is added to its row."""

    def __init__(self) -> None:
        self.rows: int | None = None
        self.media_seconds: float | None = None

    def run(self, df: DataFrame, action: Callable[[DataFrame], object], media_seconds: Column | None = None):
        """The result of ``action``, which must read ``df`` whole once; its rows, and the sum of ``media_seconds`` over them, are counted on the way and without another pass."""
        seen = Observation(f"stage-{uuid.uuid4().hex}")
        sums = [F.sum(media_seconds.cast("double")).alias("media_seconds")] if media_seconds is not None else []
        out = action(df.observe(seen, F.count(F.lit(1)).alias("rows"), *sums))
        told = seen.get
        self.rows = (self.rows or 0) + told["rows"]
        if sums:
            self.media_seconds = (self.media_seconds or 0.0) + (told["media_seconds"] or 0.0)
        return out


class Recorder:
    """Collects rows from any thread and appends them to the table at ``path``: when :data:`HELD` are there, and by :meth:`flush`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._held: list[tuple] = []
        self._lock = threading.Lock()

    def add(self, stage: str, started: float, seconds: float, failed: bool, rows: int | None, media_seconds: float | None = None, flush: bool = True) -> None:
        if not stage.strip():
            raise ValueError("a stage has a name")
        with self._lock:
            self._held.append((stage, datetime.fromtimestamp(started, timezone.utc), float(seconds), failed, rows, media_seconds))
            full = len(self._held) >= HELD
        if full and flush:
            self.flush()

    @contextmanager
    def stage(self, name: str) -> Iterator[Span]:
        """Time what happens inside; an exception counts as a failure and goes on."""
        span, started, clock, failed = Span(), time.time(), time.perf_counter(), True
        try:
            yield span
            failed = False
        finally:
            self.add(name, started, time.perf_counter() - clock, failed, span.rows, span.media_seconds)

    def flush(self) -> None:
        with self._lock:
            rows, self._held = self._held, []
        if rows:
            try:
                self.spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(self.path)
            except BaseException:
                with self._lock:
                    self._held = rows + self._held
                raise

    def table(self) -> DataFrame:
        """All rows so far."""
        self.flush()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(ROW).parquet(self.path) if there else self.spark.createDataFrame([], ROW)


class StreamRecorder(StreamingQueryListener):
    """A row for each batch of each named stream, and a failed one for a stream that ends in an error. Add it by ``spark.streams.addListener``; events come later than what they
    tell of, so :meth:`wait` for the end of a stream before its rows are read."""

    def __init__(self, recorder: Recorder) -> None:
        self.recorder = recorder
        self._names: dict[str, str] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end(self, run_id: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        started = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp()
        self.recorder.add(p.name or str(p.id), started, p.batchDuration / 1000, False, p.numInputRows, flush=False)  # no job from within the listener

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if event.exception:
            self.recorder.add(self._names.get(run, str(event.id)), time.time(), 0.0, True, None, flush=False)
        self._end(run).set()

    def wait(self, query, seconds: float = 60) -> None:
        """Until the end of a stream has been told."""
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no event of the end of {query.name or query.id} within {seconds} s")


def timings(rows: DataFrame) -> DataFrame:
    """Per stage: n, failed, total and longest (seconds), rows, media_seconds, real_time_factor (seconds of work for one of media; null without media)."""
    per = rows.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed"), F.sum("seconds").alias("total"), F.max("seconds").alias("longest"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("media_seconds").alias("media_seconds"),
    )
    return per.withColumn("real_time_factor", F.when(F.col("media_seconds") > 0, F.col("total") / F.col("media_seconds")))


def resource_summary(samples: DataFrame, estimate_bytes: Column | None = None) -> DataFrame:
    """One row of samples (sampled_at, rss_bytes, cpu_percent): samples, the first, greatest and mean memory, the greatest and mean CPU share, and the greatest memory against an
    estimate (null without one above zero). Without samples all are 0. Of samples of one time the smallest counts as first."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    first = F.min(F.struct("sampled_at", "rss_bytes"))["rss_bytes"]
    out = samples.agg(
        F.count(F.lit(1)).alias("samples"), zero(first).alias("baseline_rss_bytes"), zero(F.max("rss_bytes")).alias("peak_rss_bytes"), F.coalesce(F.avg("rss_bytes"), F.lit(0.0)).alias("mean_rss_bytes"),
        F.coalesce(F.max("cpu_percent"), F.lit(0.0)).alias("peak_cpu_percent"), F.coalesce(F.avg("cpu_percent"), F.lit(0.0)).alias("mean_cpu_percent"),
    )
    estimate = estimate_bytes if estimate_bytes is not None else F.lit(None).cast("double")
    return out.withColumn("peak_to_estimate", F.when(estimate > 0, F.col("peak_rss_bytes") / estimate))
