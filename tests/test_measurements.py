"""Recorded stages and streams against a recount of what they did."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.streaming.measurements import Recorder, StreamRecorder, resource_summary, timings


def test_stages_equal_a_recount(spark, tmp_path):
    recorder = Recorder(spark, f"file://{tmp_path}/m")
    rows = spark.range(1000, numPartitions=4).withColumn("s", F.col("id") / 10)
    assert recorder.table().count() == 0
    for part in (rows, rows.filter("id < 10"), rows.limit(0)):
        with recorder.stage("write") as span:
            span.run(part, lambda df: df.write.mode("overwrite").parquet(f"file://{tmp_path}/out"), F.col("s"))
    with recorder.stage("plain"):
        pass
    with pytest.raises(ZeroDivisionError), recorder.stage("write"):
        raise ZeroDivisionError
    with pytest.raises(Exception, match="broken"), recorder.stage("job") as span:
        span.run(rows.select(F.raise_error(F.lit("broken"))), lambda df: df.collect())
    table = recorder.table()
    found = {r["stage"]: r.asDict() for r in timings(table).collect()}
    assert {k: (v["n"], v["failed"], v["rows"]) for k, v in found.items()} == {"write": (4, 1, 1010), "plain": (1, 0, 0), "job": (1, 1, 0)}
    write = found["write"]
    assert write["media_seconds"] == pytest.approx(sum(range(1000)) / 10 + 4.5) and write["longest"] <= write["total"]
    assert write["real_time_factor"] == pytest.approx(write["total"] / write["media_seconds"]) and found["plain"]["real_time_factor"] is None
    assert table.filter("seconds < 0 OR started_at IS NULL").count() == 0 and Recorder(spark, recorder.path).table().count() == 6
    with pytest.raises(ValueError, match="name"):
        recorder.add(" ", 0, 0, False, 0)


def test_streams_tell_their_batches_and_failures(spark, tmp_path):
    for k in range(3):
        spark.range(10 * (k + 1)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    listener = StreamRecorder(recorder := Recorder(spark, f"file://{tmp_path}/m"))
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        good = source.writeStream.queryName("good").format("noop").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c1").start()
        good.awaitTermination()
        listener.wait(good)
        bad = source.select(F.raise_error(F.lit("broken")).alias("x")).writeStream.queryName("bad").format("noop").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c2").start()
        with pytest.raises(Exception, match="broken"):
            bad.awaitTermination()
        listener.wait(bad)
    finally:
        spark.streams.removeListener(listener)
    found = {r["stage"]: r for r in timings(recorder.table()).collect()}
    assert (found["good"]["rows"], found["good"]["failed"]) == (60, 0) and found["good"]["n"] >= 3
    assert found["bad"]["failed"] == 1


def test_resource_samples(spark):
    samples = spark.createDataFrame([(2, 30, 50.0), (1, 10, 0.0), (3, 20, 100.0)], "sampled_at long, rss_bytes long, cpu_percent double")
    assert tuple(resource_summary(samples, F.lit(60)).first()) == (3, 10, 30, 20.0, 100.0, 50.0, 0.5)
    assert tuple(resource_summary(samples.limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0.0, None)
