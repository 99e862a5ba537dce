"""Bucketed tables: what a change rewrites, replays, and a writer lost half-way."""

from pathlib import Path

import pytest
from pyspark.sql import types as T

from plenum.sources.buckets import BUCKET, BucketedTable
from plenum.streaming import jobs

SHAPE = T.StructType([T.StructField("k", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("v", T.StringType())])


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable(spark, str(tmp_path / "table"), SHAPE, ("k",), 8)


def files(table):
    """Names of the data files by bucket."""
    found = {}
    for f in Path(table.path).glob(f"{BUCKET}=*/*.parquet"):
        found.setdefault(int(f.parent.name.split("=")[1]), set()).add(f.name)
    return found


def test_only_touched_buckets_are_rewritten(spark, table, rows):
    assert rows(table.read()) == []
    first = [(k, 1, "a") for k in range(100)] + [(None, 1, "n")]
    assert table.upsert_newest(spark.createDataFrame(first, SHAPE), ["seq"]) == list(range(8))
    before = files(table)
    change = spark.createDataFrame([(5, 2, "b"), (5, 0, "old"), (7, 0, "late")], SHAPE)
    touched = table.upsert_newest(change, ["seq"])
    after = files(table)
    assert 0 < len(touched) <= 2
    assert all((before[b] == after[b]) == (b not in touched) for b in before)
    want = sorted([(k, 2, "b") if k == 5 else (k, 1, "a") for k in range(100)] + [(None, 1, "n")], key=repr)
    assert rows(table.read()) == want
    table.upsert_newest(change, ["seq"])
    assert rows(table.read()) == want
    assert table.upsert_newest(change.limit(0), ["seq"]) == []
    assert all(len(names) <= 2 for names in files(table).values())


def test_replaced_and_emptied_buckets(spark, table, rows):
    table.rewrite(spark.createDataFrame([(k, s, "a") for k in (1, 2, 3) for s in range(3)], SHAPE), lambda old, new: new)
    table.replace(spark.createDataFrame([(2, 9, "z"), (4, 9, "z")], SHAPE))
    want = sorted([(k, s, "a") for k in (1, 3) for s in range(3)] + [(2, 9, "z"), (4, 9, "z")], key=repr)
    assert rows(table.read()) == want
    gone = spark.createDataFrame([(k, 0, "") for k in (1, 2, 3, 4)], SHAPE)
    table.rewrite(gone, lambda old, new: old.join(new.select("k"), "k", "left_anti"))
    assert rows(table.read()) == [] and files(table) == {}


def test_lost_writer(spark, table, rows, monkeypatch):
    """The writer is lost after it removed what it was to replace."""
    table.upsert_newest(spark.createDataFrame([(k, 1, "a") for k in range(50)], SHAPE), ["seq"])
    change = spark.createDataFrame([(k, 2, "b") for k in range(3)], SHAPE)

    def lost(self, rows):
        for r in rows.select(BUCKET).distinct().collect():
            self._delete(f"{BUCKET}={r[0]}")
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(BucketedTable, "_place", lost)
        with pytest.raises(RuntimeError):
            table.upsert_newest(change, ["seq"])
    table.upsert_newest(change, ["seq"])  # the batch is replayed
    want = sorted([(k, 2, "b") if k < 3 else (k, 1, "a") for k in range(50)], key=repr)
    assert rows(table.read()) == want


def test_stream(spark, table, tmp_path, rows):
    path = str(tmp_path / "in")
    data = [(i % 9, (i * 37) % 101, str(i)) for i in range(100)]
    for part in range(4):
        spark.createDataFrame(data[part::4], SHAPE).coalesce(1).write.mode("append").parquet(path)
    feed = jobs.file_stream(spark, path, SHAPE, files_per_batch=1)
    for _ in range(2):  # the second start finds nothing new
        jobs.stream_into_buckets(feed, table, str(tmp_path / "cp"), ["seq"]).awaitTermination()
    want = sorted((max((r for r in data if r[0] == k), key=lambda r: r[1]) for k in range(9)), key=repr)
    assert rows(table.read()) == want
