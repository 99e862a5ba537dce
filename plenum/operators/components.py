"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators.skew import grouped_for_join
from plenum.session import materialize, release


def connected_components(nodes: DataFrame, links: DataFrame, *, node: str, a: str, b: str, name: str = "component") -> DataFrame:
    """``nodes`` with ``name``, the smallest node that links lead to. Nodes without links are
    components of their own; links to unknown nodes and NULLs count for nothing.

    In each round a node takes the smallest name among its neighbours' and then that name's
    own name, so the rounds grow with the logarithm of the longest way. A round is a written
    table; only whether a name changed comes to the driver. A node with very many links is one
    hot join key, which is split; the smallest name among neighbours is found before the
    shuffle. Repeated nodes stay repeated."""
    known = nodes.select(F.col(node).alias("node")).filter("node is not null").distinct()
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    pairs = pairs.union(pairs.select("other", "node")).distinct()
    pairs = pairs.join(known, "node", "left_semi").join(known.select(F.col("node").alias("other")), "other", "left_semi")
    pairs = materialize(pairs.select("node", "other"), "links")
    least = pairs.groupBy("node").agg(F.least("node", F.min("other")).alias("name"))
    state = materialize(least, "names")
    while True:
        names = state.select(F.col("node").alias("other"), F.col("name").alias("near"))
        near = grouped_for_join(pairs.join(names, "other"), ["node"], F.min("near").alias("near"))
        met = state.join(near, "node").select("node", "name", F.least("name", "near").alias("low"))
        far = state.select(F.col("node").alias("low"), F.col("name").alias("far"))
        moved = met.join(far, "low").select("node", F.col("name").alias("old"), F.least("low", "far").alias("name"))
        moved = materialize(moved, "names")
        release(state)
        state = moved.drop("old")
        done = moved.filter("old <> name").isEmpty()
        if done:
            found = state.select(F.col("node").alias("_node"), F.col("name").alias("_name"))
            joined = nodes.join(found, F.col(node) == F.col("_node"), "left")
            return joined.withColumn(name, F.coalesce("_name", F.col(node))).drop("_node", "_name")
        state.written_to = moved.written_to
