"""Streaming jobs over the events file, compared with what a batch query gives."""

import uuid

from pyspark.sql import functions as F

from plenum.plans.registry import query
from plenum.plans.tables import SCHEMAS
from plenum.session import shared_dir
from plenum.sources.buckets import BucketedTable
from plenum.sources.io import seed
from plenum.streaming import jobs


def stream(t):
    return jobs.file_stream(t.spark, t.dir, SCHEMAS["events"], glob="events.parquet")


def folders(t):
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/sink", f"{base}/checkpoint"


@query(
    "stream_upsert",
    """SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events) WHERE pos = 1""",
)
def stream_upsert(t):
    sink, checkpoint = folders(t)
    rows = stream(t).select("user_id", "event_id", "ts", "event_type")
    jobs.stream_upsert(rows, sink, checkpoint, ["user_id"], ["ts", "event_id"]).awaitTermination()
    return jobs.read_upserted(t.spark, sink, rows.schema, ["user_id"], ["ts", "event_id"])


@query(
    "stream_into_buckets",
    """SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events) WHERE pos = 1""",
)
def stream_into_buckets(t):
    """The newest event of each user, from four micro-batches, in a table of buckets."""
    sink, checkpoint = folders(t)
    arrived = f"{sink}-in"
    events = t("events", "user_id", "event_id", "ts", "event_type")
    events.repartition(4, "event_id").write.parquet(arrived)
    feed = jobs.file_stream(t.spark, arrived, events.schema, files_per_batch=1)
    table = BucketedTable(t.spark, sink, events.schema, ("user_id",), 8)
    jobs.stream_into_buckets(feed, table, checkpoint, ["ts", "event_id"]).awaitTermination()
    return table.read()


@query(
    "stream_ready",
    """SELECT user_id FROM events GROUP BY user_id
    HAVING bool_or(event_type = 'click' AND value > 150) AND bool_or(event_type = 'view')""",
)
def stream_ready(t):
    """The events arrive in four micro-batches; each user is emitted once."""
    sink, checkpoint = folders(t)
    arrived = f"{sink}-in"
    t("events", "event_id", "user_id", "event_type", "value").repartition(4, "event_id").write.parquet(arrived)
    events = jobs.file_stream(t.spark, arrived, "event_id bigint, user_id bigint, event_type string, value double", files_per_batch=1)
    vote = (F.col("event_type") == "click") & (F.col("value") > 150)
    kind = F.when(vote, "votes").when(F.col("event_type") == "view", "analysis").otherwise("none")
    jobs.stream_ready(events, sink, checkpoint, "user_id", kind, ["votes", "analysis"]).awaitTermination()
    return jobs.read_ready(t.spark, sink, "user_id bigint").select("user_id")


STAGES = ["signup", "view", "click", "purchase"]


@query(
    "stream_stage",
    """SELECT user_id, arg_max(event_type, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2
        WHEN 'click' THEN 3 ELSE 4 END) AS stage
    FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def stream_stage(t):
    sink, checkpoint = folders(t)
    ranks = seed(t.spark, [(s, i + 1) for i, s in enumerate(STAGES)], "stage string, rank int")
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("event_type")).cast("int")
    rows = stream(t).filter("event_type <> 'error'")
    jobs.stream_stage(rows, sink, checkpoint, "user_id", rank).awaitTermination()
    return jobs.read_stage(t.spark, sink, "user_id bigint, rank int", "user_id", ranks)


@query(
    "stream_counters",
    """SELECT user_id, count(*) AS items_processed, count(*) FILTER (event_type = 'error') AS items_failed
    FROM events GROUP BY user_id""",
)
def stream_counters(t):
    sink, checkpoint = folders(t)
    counters = {"items_processed": F.lit(True), "items_failed": F.col("event_type") == "error"}
    jobs.stream_counters(stream(t), sink, checkpoint, ["user_id"], counters).awaitTermination()
    schema = "user_id bigint, items_processed bigint, items_failed bigint"
    return jobs.read_counters(t.spark, sink, schema, ["user_id"], list(counters))
