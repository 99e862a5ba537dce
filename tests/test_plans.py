"""Shapes of physical plans: what must not happen at scale."""

import contextlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from plenum.operators import joins, scoring
from plenum.plans.registry import QUERIES
from plenum.sources import merge
from plenum.sources.io import seed

SF_DIR = "/root/testdata/sf0.001"

# One-row results, and the starts of the id buckets (at most 4096 rows).
MEETS_IN_ONE_TASK = {
    "row_count", "null_count", "next_id", "quality_report", "null_profile_diff",
    "check_references", "assign_ids", "split_dimension", "split_bridge",
}
# Distances are computed on Arrow batches.
VECTORS = {"cosine_distance", "cosine_distance_pairs", "nearest", "nearest_filtered", "nearest_owner"}
EAGER = {"concept_groups", "nearest_join", "classify", "resolve_ancestor"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in EAGER and not n.startswith("stream_")))
def test_no_pairwise_join_and_no_single_task(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    if name not in VECTORS:
        assert "Python" not in plan and "Arrow" not in plan
    assert "BatchEvalPython" not in plan and plan.count("ArrowEvalPython") <= 1
    if name not in MEETS_IN_ONE_TASK:
        assert "SinglePartition" not in plan


@contextlib.contextmanager
def small_skew_limits(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10kb",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def hot_tables(spark):
    """A fact table with half of its rows on one key, and a table of all keys."""
    fact = spark.range(0, 60000, 1, 8).select(
        "id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("fk"),
        F.xxhash64("id").alias("payload"),
    )
    return fact, spark.range(0, 60000, 1, 8).select(F.col("id").alias("fk"), F.hash("id").alias("v"))


def identity(fact, dim):
    none = F.lit(None).cast("long").alias("member_id")
    positions = fact.select("payload", none, F.col("fk").alias("lis_member_id"))
    return joins.resolve_identity(positions, dim.toDF("lis_member_id", "member_id"))


def branch(fact, dim):
    rows = fact.withColumn("a", F.when(F.col("payload") > 0, F.col("fk")))
    return joins.branch_lookup(rows, dim, dim, a_key="a", b_key="fk", lookup_key="fk", values=["v"])


def cascade(fact, dim):
    tables = {"dim": dim, "fact": fact}
    doomed = dim.filter("fk > 100").select("fk")
    return merge.cascade_delete(tables, [("fact", ["fk"], "dim", ["fk"])], "dim", doomed)["fact"]


def stances(fact, dim):
    positions = fact.select(F.col("payload").alias("member_id"), F.col("id").alias("vote_id"), F.lit("Yea").alias("position"))
    votes = fact.select(F.col("id").alias("vote_id"), F.col("fk").alias("bill_id"), "payload")
    bills = dim.select(F.col("fk").alias("bill_id"))
    analyses = fact.select(F.col("id").alias("bill_id"), F.col("id").alias("analysis_id"),
                           F.col("payload").alias("completed_at"), F.array(F.lit("t")).alias("topics"))
    return scoring.materialize_stances(positions, votes, bills, analyses)


HOT = {
    "lookup": lambda fact, dim: joins.lookup_update(fact, dim, {"fk": "fk"}, {"w": "v"}),
    "first match": lambda fact, dim: joins.lookup_update(fact, dim, {"fk": "fk"}, {"w": "v"}, pick="min"),
    "remap": lambda fact, dim: joins.remap_fk(fact, dim, "fk", "fk", "v", strict=True),
    "identity": identity,
    "orphans": lambda fact, dim: joins.drop_orphans(fact, fact.select("id"), "fk", "id"),
    "unprocessed": lambda fact, dim: joins.unprocessed(fact, dim.filter("fk > 100"), "fk"),
    "replace": lambda fact, dim: merge.replace_by_key(fact, fact.filter("id > 59000"), "fk"),
    "branch": branch,
    "cascade": cascade,
    "stances": stances,
    "grouped": lambda fact, dim: joins.lookup_update(fact, dim, {"fk": "fk"}, {"w": "v"})
    .groupBy("fk").agg(F.sum("w").alias("w"), F.max("payload").alias("p")),
}


@pytest.mark.parametrize("operator", sorted(HOT))
def test_hot_key_partition_is_split(spark, operator):
    """Half of the rows on one key: AQE cuts that partition into several tasks."""
    with small_skew_limits(spark):
        df = HOT[operator](*hot_tables(spark))
        df.collect()
        plan = plan_of(df)
    assert "skew=true" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["named_subset"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(event_type,error)" in plan and "GreaterThan(value,100.0)" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan


def test_literal_relations_are_part_of_the_plan(spark):
    assert "LocalTableScan" in plan_of(seed(spark, [("a", 1)], "code string, id int"))
