"""Walking parent pointers to the root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.session import materialize


def resolve_ancestor(
    nodes: DataFrame, id_: str, parent: str, payload: Sequence[str] = (), *, root: str = "root_id",
    depth: str = "depth",
) -> DataFrame:
    """Every node with its root, its depth, and columns of the root.

    Each round replaces a node's pointer by the pointer of the node it points at,
    so the distance covered doubles and a tree of depth ``d`` takes about
    ``log2(d)`` joins. A round touches only nodes still below an inner node, and is
    written to the shared folder. Nodes on or under a cycle, or under a missing
    parent, have a NULL root and NULL depth.
    """
    state = materialize(
        nodes.select(
            F.col(id_).alias("node"),
            F.coalesce(F.col(parent), F.col(id_)).alias("up"),
            F.col(parent).isNull().alias("done"),
            F.col(parent).isNotNull().cast("bigint").alias("hops"),
        ),
        "ancestor",
    )
    settled, pending = state.filter("done"), state.filter("NOT done")
    waiting, before = pending.count(), -1
    while waiting and waiting != before:
        pointers = settled.unionByName(pending).select(
            F.col("node").alias("p_node"),
            F.col("up").alias("p_up"),
            F.col("done").alias("p_done"),
            F.col("hops").alias("p_hops"),
        )
        moved = pending.join(pointers, F.col("up") == F.col("p_node"), "left").select(
            "node",
            F.col("p_up").alias("up"),
            F.coalesce("p_done", F.lit(True)).alias("done"),
            (F.col("hops") + F.col("p_hops")).alias("hops"),
        )
        step = materialize(moved, "ancestor")
        settled, pending = settled.unionByName(step.filter("done")), step.filter("NOT done")
        waiting, before = pending.count(), waiting
    lost = pending.select(
        "node", F.lit(None).cast(state.schema["up"].dataType).alias("up"), "done",
        F.lit(None).cast("bigint").alias("hops"),
    )
    found = settled.unionByName(lost).select(
        F.col("node").alias(id_), F.col("up").alias(root), F.col("hops").alias(depth)
    )
    if not payload:
        return found
    roots = nodes.select(F.col(id_).alias("_root"), *[F.col(c).alias(f"root_{c}") for c in payload])
    return found.join(roots, F.col(root) == F.col("_root"), "left").drop("_root")
