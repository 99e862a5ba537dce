"""Reducing one side of a join without losing the split of hot keys on the other.

AQE splits a hot partition only if both sides of the join come straight from a
shuffle. A side that was just grouped on the join key is not shuffled again, and
the join then has to take the other side's partitions whole. Grouping on the key
and its hash gives the same groups, but a partitioning that does not serve the
join, so the reduced side is shuffled once more and the split stays possible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = "_key_hash"


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The different keys of ``df``, to be joined with a larger side."""
    return df.select(*keys).withColumn(HASH, key_hash(keys)).distinct().drop(HASH)


def grouped_for_join(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """``groupBy(keys).agg(...)``, to be joined with a larger side."""
    return df.withColumn(HASH, key_hash(keys)).groupBy(*keys, HASH).agg(*aggregates).drop(HASH)
