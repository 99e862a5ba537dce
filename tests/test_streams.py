"""Several micro-batches give the same table as one batch query."""

import time

import pytest
from pyspark.sql import functions as F

from plenum.streaming import jobs

SCHEMA = "seq long, k long, kind string, ts long"
ROWS = [(i, i % 7, ["IH", "RH", "ENR", "none"][(i * 5) % 4], (i * 37) % 101) for i in range(200)]


@pytest.fixture
def feed(spark, tmp_path):
    """Four files, arriving in an order that has nothing to do with ts."""
    path = str(tmp_path / "in")
    for part in range(4):
        spark.createDataFrame(ROWS[part::4], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.file_stream(spark, path, SCHEMA, files_per_batch=1)
    return stream, str(tmp_path / "sink"), str(tmp_path / "cp")


def test_upsert_and_replay(spark, feed, rows):
    stream, sink, checkpoint = feed
    for _ in range(2):  # the second start finds nothing new
        jobs.stream_upsert(stream, sink, checkpoint, ["k"], ["ts", "seq"]).awaitTermination()
    got = rows(jobs.read_upserted(spark, sink, SCHEMA, ["k"], ["ts", "seq"]))
    want = sorted((max((r for r in ROWS if r[1] == k), key=lambda r: (r[3], r[0])) for k in range(7)), key=repr)
    assert got == want
    assert jobs.read_batches(spark, sink, SCHEMA).select("batch_id").distinct().count() == 4


def test_ready(spark, feed, rows):
    stream, sink, checkpoint = feed
    late = F.when((F.col("kind") == "ENR") & (F.col("k") > 3), "votes").otherwise(F.col("kind"))
    for _ in range(2):  # the second start finds nothing new
        jobs.stream_ready(stream, sink, checkpoint, "k", late, ["votes", "IH"]).awaitTermination()
    found = jobs.read_ready(spark, sink, "k long")
    assert rows(found, "k") == [(4,), (5,), (6,)]  # once each, though later batches touch them again


def arrive(spark, folder, *batches):
    """One file for each batch of (key, kind, seconds), read in this order."""
    for number, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "k string, kind string, s long").selectExpr("k", "kind", "timestamp_seconds(s) AS ts")
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by their time, in seconds
    return jobs.file_stream(spark, folder, "k string, kind string, ts timestamp", files_per_batch=1)


def test_ready_in_the_batch_of_the_last_kind(spark, tmp_path, rows):
    stream = arrive(
        spark, str(tmp_path / "in"),
        [("x", "b", 0), ("y", "a", 1), ("y", "a", 2), (None, "a", 3), (None, "b", 3)],
        [("x", "c", 4), ("y", "b", 5), ("z", "b", 6), ("z", "a", 6)],
        [("x", "a", 7), ("y", "a", 8), ("y", "b", 8), ("z", "a", 9)],
        [("x", "b", 10), ("x", "a", 11)],
    )
    jobs.stream_ready(stream, str(tmp_path / "sink"), str(tmp_path / "cp"), "k", "kind", ["a", "b"]).awaitTermination()
    assert rows(jobs.read_ready(spark, str(tmp_path / "sink"), "k string")) == [("x", 2), ("y", 1), ("z", 1)]


def test_ready_forgets_keys_that_nothing_touches(spark, tmp_path, rows):
    stream = arrive(
        spark, str(tmp_path / "in"),
        [("x", "a", 1000), ("y", "a", 1000), ("y", "b", 1000)],
        [("x", "b", 1050), ("w", "a", 9000)],
        [("w", "c", 9001)],
        [("w", "b", 9002), ("y", "a", 9003), ("x", "a", 9003)],
        [("y", "b", 9004), ("x", "a", 9005), ("v", "a", 10), ("v", "b", 10)],
    )
    jobs.stream_ready(
        stream, str(tmp_path / "sink"), str(tmp_path / "cp"), "k", "kind", ["a", "b"], event_time="ts", forget_after=100
    ).awaitTermination()
    # y starts afresh after its state has gone; v is older than the watermark.
    assert rows(jobs.read_ready(spark, str(tmp_path / "sink"), "k string")) == [("w", 3), ("x", 1), ("y", 0), ("y", 4)]


def test_stage(spark, feed, rows):
    stream, sink, checkpoint = feed
    ranks = spark.createDataFrame([("IH", 1), ("RH", 2), ("ENR", 3)], "stage string, rank int")
    rank = F.when(F.col("kind") == "IH", 1).when(F.col("kind") == "RH", 2).otherwise(3)
    source = stream.filter("kind <> 'none' AND NOT (kind = 'ENR' AND k < 2)")
    jobs.stream_stage(source, sink, checkpoint, "k", rank).awaitTermination()
    got = rows(jobs.read_stage(spark, sink, "k long, rank int", "k", ranks))
    assert got == [(0, "RH"), (1, "RH")] + [(k, "ENR") for k in range(2, 7)]


def test_counters(spark, feed, rows):
    stream, sink, checkpoint = feed
    counters = {"n": F.lit(True), "bad": F.col("kind") == "none"}
    jobs.stream_counters(stream, sink, checkpoint, ["k"], counters).awaitTermination()
    got = rows(jobs.read_counters(spark, sink, "k long, n long, bad long", ["k"], ["n", "bad"]))
    want = [(k, sum(r[1] == k for r in ROWS), sum(r[1] == k and r[2] == "none" for r in ROWS)) for k in range(7)]
    assert got == want
