"""Ordered-per-key operators.

Every ``row_number() <= n`` filter here is recognised by Spark as a group limit:
each map task keeps at most ``n`` rows per key before the shuffle, so a key that
holds a large share of the table does not arrive whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.scalar import as_column
from plenum.operators.skew import key_hash


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str | None = None,
    *, for_join: bool = False,
) -> DataFrame:
    """The first ``n`` rows of each key in a total order; ``rank`` names an output
    column for the position. ``for_join`` prepares the result for a join on the
    same key with a larger side (see ``skew``)."""
    position = rank or "_position"
    groups = [*keys, key_hash(keys)] if for_join else keys
    spec = Window.partitionBy(*groups).orderBy(*[as_column(o) for o in order])
    best = df.withColumn(position, F.row_number().over(spec)).filter(F.col(position) <= n)
    return best if rank else best.drop(position)


def latest(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *, for_join: bool = False
) -> DataFrame:
    """The newest row of each key; ``order`` lists what to compare, most
    significant first, each compared descending."""
    newest_first = [as_column(o).desc_nulls_last() for o in order]
    return top_per_key(df, keys, newest_first, 1, for_join=for_join)


def dedupe_keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """Keep the smallest row of each key. ``order`` must be total for the result
    to be repeatable. NULL keys are equal to each other here."""
    return top_per_key(df, keys, order, 1)


def seniority(
    members: DataFrame, keys: Sequence[str], rank: str, ties: Sequence[str], n: int,
    position: str = "seniority",
) -> DataFrame:
    """The ``n`` most senior rows per key: lower rank first, unranked last."""
    order = [F.col(rank).asc_nulls_last(), *ties]
    return top_per_key(members, keys, order, n, position)


def highlights(
    evidence: DataFrame, keys: Sequence[str], alignment: str, ties: Sequence[str], n: int,
    position: str = "position",
) -> DataFrame:
    """The ``n`` strongest alignments per key, ties broken by id."""
    return top_per_key(evidence, keys, [F.col(alignment).desc_nulls_last(), *ties], n, position)


def trend(
    history: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    slice_by: Column,
    *,
    previous: str = "previous",
    delta: str = "delta",
) -> DataFrame:
    """Each point of a series with the value before it and the change.

    ``slice_by`` is a column that never decreases along ``order`` (a month of the
    timestamp, say). The series of a key is worked on slice by slice, so a key
    with a third of the table spreads over many tasks; the value carried from one
    slice into the next comes from one aggregated row per key and slice.
    """
    sliced = history.withColumn("_slice", slice_by)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    marked = sliced.withColumns(
        {"_before": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1}
    )
    across = Window.partitionBy(*keys).orderBy("_slice")
    edges = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
        .withColumn("_carried", F.lag(F.col("_last")[value]).over(across))
        .select(*[F.col(k).alias(f"_edge_{k}") for k in keys], F.col("_slice").alias("_edge_slice"), "_carried")
    )
    same = F.col("_slice").eqNullSafe(F.col("_edge_slice"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_edge_{k}"))
    before = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))
    return (
        marked.join(edges, same, "left")
        .withColumn(previous, before)
        .withColumn(delta, F.col(value) - F.col(previous))
        .select(*history.columns, previous, delta)
    )


def in_order(df: DataFrame, order: Sequence[Column | str], unique: Sequence[str]) -> DataFrame:
    """Global ordering. The unique columns end the sort key, so that range
    partitioning can split a run of equal leading values."""
    return df.orderBy(*order, *unique)
