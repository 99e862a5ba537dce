"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; a component is named by its
    smallest node. Each round, a node's parent becomes the smallest parent around it and
    then its parent's parent, so rounds grow with the logarithm of the longest path. Every
    round is a written table; only a count comes to the driver."""
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = both.union(links.select(F.col(b), F.col(a))).filter("node <> other").distinct()
    both = materialize(both, "links")
    state = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "components")
    while True:
        parents = state.select(F.col("node").alias("other"), F.col("component").alias("_near"))
        near = both.join(parents, "other").groupBy("node").agg(F.min("_near").alias("_near"))
        lower = state.join(near, "node", "left").select(
            "node", "component", F.least("component", F.coalesce("_near", "component")).alias("_low")
        )
        jump = state.select(F.col("node").alias("_low"), F.col("component").alias("_far"))
        moved = lower.join(jump, "_low", "left").select(
            "node", F.col("component").alias("_old"), F.least("_low", F.coalesce("_far", "_low")).alias("component")
        )
        moved = materialize(moved, "components")
        if moved.filter("_old <> component").isEmpty():
            return moved.drop("_old")
        state = moved.drop("_old")


def joined_components(labels: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``labels`` (node, component) after more links. Only the components that the new links
    join are worked on; nodes without a label join with their own name."""
    left = labels.select(F.col("node").alias(a), F.col("component").alias("_a"))
    right = labels.select(F.col("node").alias(b), F.col("component").alias("_b"))
    named = links.join(left, a, "left").join(right, b, "left")
    named = named.select(a, b, F.coalesce("_a", a).alias("_a"), F.coalesce("_b", b).alias("_b"))
    named = materialize(named, "new_links")
    moved = components(named.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    moved = moved.select(F.col("node").alias("_old"), F.col("component").alias("_new"))
    nodes = labels.union(named.select(a, "_a")).union(named.select(b, "_b")).distinct()
    found = nodes.join(moved, F.col("component") == F.col("_old"), "left")
    return materialize(found.select("node", F.coalesce("_new", "component").alias("component")), "components")
