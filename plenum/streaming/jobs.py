"""Polling steps as Structured Streaming jobs.

Every job writes what a micro-batch changed into its own ``batch_id=N`` folder of
the sink, overwriting that folder if the batch is replayed after a failure. A
reader combines the folders, so nothing already written is rewritten per batch.
State is one small row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from plenum.functions.scalar import as_column
from plenum.operators.windows import latest
from plenum.sources.buckets import BucketedTable


def file_stream(
    spark: SparkSession, path: str, schema: StructType | str, *, glob: str = "*.parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def _start(
    stream: DataFrame, sink: str, checkpoint: str, mode: str,
    shape: Callable[[DataFrame], DataFrame] = lambda batch: batch,
) -> StreamingQuery:
    """Process everything available, one folder per micro-batch, then stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def read_batches(spark: SparkSession, sink: str, schema: StructType | str) -> DataFrame:
    """All micro-batch folders of a sink, with the ``batch_id`` of each row."""
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    shape = StructType(list(shape.fields)).add("batch_id", "long")
    return spark.read.schema(shape).option("basePath", sink).parquet(sink)


def stream_upsert(
    stream: DataFrame, sink: str, checkpoint: str, keys: Sequence[str],
    order: Sequence[Column | str],
) -> StreamingQuery:
    """Upsert by key: the newest row of each key per micro-batch goes to the sink."""
    return _start(stream, sink, checkpoint, "append", lambda batch: latest(batch, keys, order))


def read_upserted(
    spark: SparkSession, sink: str, schema: StructType | str, keys: Sequence[str],
    order: Sequence[Column | str],
) -> DataFrame:
    """The table behind an upsert sink: per key the newest row, whichever batch
    brought it."""
    rows = read_batches(spark, sink, schema)
    return latest(rows, keys, [*order, "batch_id"]).drop("batch_id")


def stream_into_buckets(
    stream: DataFrame, table: BucketedTable, checkpoint: str, order: Sequence[Column | str]
) -> StreamingQuery:
    """Upsert by key into a bucketed table: a micro-batch rewrites the buckets of its keys,
    which stay compact, and readers need no window. A replayed batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert_newest(latest(batch, list(table.keys), order), order)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def stream_ready(
    stream: DataFrame, sink: str, checkpoint: str, key: str, kind: str | Column, kinds: Sequence[str],
    *, event_time: str | None = None, forget_after: int = 30 * 86_400,
) -> StreamingQuery:
    """Emit a key in the micro-batch in which the last kind of input is seen for it, in
    whatever order they come, and never again: not when it is touched later, nor on replay.

    State is one number per key: a bit for each kind seen and one for having been emitted.
    Rows that say the same of a key are reduced to one where they are read, so a key with a
    third of all rows sends few of them to its state. Without ``event_time`` state is kept
    for good. With it, a key that nothing has touched for ``forget_after`` seconds, by the
    stream's watermark, is forgotten, and rows older than the watermark are left out; what
    comes later for such a key starts afresh. NULL keys and other kinds count for nothing."""
    if len(kinds) > 62:
        raise ValueError("at most 62 kinds")
    value, whole = as_column(kind), (1 << len(kinds)) - 1
    emitted = 1 << len(kinds)
    bits = sum((F.when(value == k, 1 << i).otherwise(0) for i, k in enumerate(kinds)), F.lit(0).cast("bigint"))
    rows = stream.withColumn("_bits", bits).filter((F.col("_bits") > 0) & F.col(key).isNotNull())
    columns = [key, "_bits"] + ([event_time] if event_time else [])
    rows = rows.select(*columns)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby([key, "_bits"], as_index=False)[columns[2:]].max() if event_time else batch.drop_duplicates()

    rows = rows.mapInPandas(reduce, rows.schema)
    if event_time:
        rows = rows.withWatermark(event_time, f"{forget_after} seconds")

    def see(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bits = before = state.get[0] if state.exists else 0
        last = state.getCurrentWatermarkMs() if event_time else 0
        for batch in batches:
            bits |= int(np.bitwise_or.reduce(batch["_bits"].to_numpy(np.int64)))
            if event_time:
                last = max(last, int(batch[event_time].max().timestamp() * 1000))
        if bits & whole == whole and not bits & emitted:
            bits |= emitted
            yield pd.DataFrame({key: [name[0]]})
        if bits != before or not state.exists:
            state.update((bits,))
        if event_time:
            state.setTimeoutTimestamp(last + forget_after * 1000)

    kind_of_key = stream.schema[key].dataType.simpleString()
    ready = (
        rows.groupBy(key)
        .applyInPandasWithState(
            see, f"{key} {kind_of_key}", "bits long", "append",
            GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout,
        )
    )
    return _start(ready, sink, checkpoint, "append")


def read_ready(spark: SparkSession, sink: str, schema: StructType | str) -> DataFrame:
    """Keys that became ready, each in the batch in which it did."""
    return read_batches(spark, sink, schema)


def stream_stage(
    stream: DataFrame, sink: str, checkpoint: str, key: str, rank: Column
) -> StreamingQuery:
    """The furthest stage rank per key; a late, lower stage changes nothing."""
    return _start(stream.groupBy(key).agg(F.max(rank).alias("rank")), sink, checkpoint, "update")


def read_stage(
    spark: SparkSession, sink: str, schema: StructType | str, key: str, ranks: DataFrame,
    stage: str = "stage",
) -> DataFrame:
    reached = read_batches(spark, sink, schema).groupBy(key).agg(F.max("rank").alias("rank"))
    named = ranks.groupBy("rank").agg(F.max(stage).alias(stage))
    return reached.join(named, "rank", "left").select(key, stage)


def stream_counters(
    stream: DataFrame, sink: str, checkpoint: str, keys: Sequence[str], counters: dict[str, Column]
) -> StreamingQuery:
    """Running counts per key; ``counters`` maps a name to the condition counted."""
    counts = stream.groupBy(*keys).agg(
        *[F.count_if(condition).alias(name) for name, condition in counters.items()]
    )
    return _start(counts, sink, checkpoint, "update")


def read_counters(
    spark: SparkSession, sink: str, schema: StructType | str, keys: Sequence[str],
    counters: Sequence[str],
) -> DataFrame:
    """The counts as of the last batch that touched each key. Counts only grow, so
    that is their maximum."""
    return (
        read_batches(spark, sink, schema)
        .groupBy(*keys)
        .agg(*[F.max(name).alias(name) for name in counters])
    )
