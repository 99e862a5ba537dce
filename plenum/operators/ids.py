"""Dense surrogate ids for natural keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_id(df: DataFrame, id_: str, name: str = "next_id") -> DataFrame:
    """Where the id counter continues: ``greatest(coalesce(max(id), 1), 1)``."""
    return df.agg(F.greatest(F.coalesce(F.max(id_), F.lit(1)), F.lit(1)).alias(name))


def assign_ids(
    new: DataFrame, key: str, *, after: int = 0, id_: str = "id", digits: int = 3
) -> DataFrame:
    """Number distinct natural keys ``after + 1, after + 2, ...`` without gaps.

    Ids follow the order of ``md5(key)``. The first ``digits`` hex digits name a
    bucket of about equal size whatever the keys look like: rows are numbered
    inside their bucket, and the start of each bucket comes from the bucket counts
    (at most ``16 ** digits`` rows). The result depends on the set of keys only, so
    recomputing a lost partition gives the same ids. Keys must be unique, not NULL.
    """
    digest = F.md5(F.col(key).cast("string"))
    hashed = new.withColumns({"_digest": digest, "_bucket": F.substring(digest, 1, digits)})
    counts = hashed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_bucket").orderBy("_digest", key)
    numbered = hashed.withColumn("_number", F.row_number().over(inside)).join(starts, "_bucket")
    number = F.lit(after).cast("bigint") + F.col("_start") + F.col("_number")
    return numbered.select(number.alias(id_), *new.columns)
