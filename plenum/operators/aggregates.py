"""Counts, rollups and per-key summaries. All of them combine on the map side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.scalar import as_column
from plenum.functions.vector import distance_to


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def null_count(df: DataFrame, *columns: str) -> DataFrame:
    """NULLs per column, in one row: what blocks tightening to NOT NULL."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def nearest_owner(
    chunks: DataFrame, query: Sequence[float], owner: str, vector: str = "embedding",
    name: str = "distance",
) -> DataFrame:
    """For each owner the distance of its closest chunk to the query vector."""
    scored = chunks.select(owner, distance_to(vector, query).alias(name))
    return scored.groupBy(owner).agg(F.min(name).alias(name))


def list_cols(
    df: DataFrame, keys: Sequence[str], value: str, order: str, separator: str = ",",
    name: str = "columns",
) -> DataFrame:
    """The ordered list of a key's values as one string, such as the columns of an
    index. Repeated entries stay; they travel once with their number. NULL values are
    left out."""
    quoted = separator.replace("'", "''")
    entries = (
        df.select(*keys, F.col(order).alias("_order"), F.col(value).cast("string").alias("_value"))
        .groupBy(*keys, "_order", "_value")
        .agg((F.count("*") - 1).cast("int").alias("_more"))
    )
    repeated = F.concat(F.repeat(F.concat("_value", F.lit(separator)), F.col("_more")), "_value")
    return (
        entries.withColumn("_entry", repeated)
        .groupBy(*keys)
        .agg(F.expr(f"listagg(_entry, '{quoted}') WITHIN GROUP (ORDER BY _order, _value)").alias(name))
    )


def dup_keys(
    df: DataFrame,
    keys: Sequence[str],
    *,
    where: Column | None = None,
    nulls_distinct: bool = True,
    name: str = "n",
) -> DataFrame:
    """Keys that occur more than once. ``where`` gives a partial key; with
    ``nulls_distinct`` a key holding a NULL never counts as repeated."""
    rows = df if where is None else df.filter(where)
    if nulls_distinct:
        rows = rows.dropna(subset=list(keys))
    return rows.groupBy(*keys).agg(F.count("*").alias(name)).filter(F.col(name) > 1)


def rollup_results(
    results: DataFrame,
    keys: Sequence[str],
    status: str,
    *,
    succeeded: str = "success",
    failed: str = "failed",
) -> DataFrame:
    """Items processed, succeeded and failed per step."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("items_processed"),
        F.count_if(F.col(status) == succeeded).alias("items_succeeded"),
        F.count_if(F.col(status) == failed).alias("items_failed"),
    )


def derive_status(rollup: DataFrame, name: str = "status") -> DataFrame:
    """No failures: completed. Some: completed_with_errors. Nothing else: failed."""
    done, bad = F.col("items_processed"), F.col("items_failed")
    return rollup.withColumn(
        name,
        F.when(bad == 0, "completed").when(bad < done, "completed_with_errors").otherwise("failed"),
    )


def errors_by_class(
    results: DataFrame, keys: Sequence[str], error_class: str, classes: Mapping[str, str]
) -> DataFrame:
    """Errors per class, one column per class; ``classes`` maps class to column."""
    return results.groupBy(*keys).agg(
        *[F.count_if(F.col(error_class) == c).alias(name) for c, name in classes.items()]
    )


def retry_state(
    steps: DataFrame, *, retries: str = "retry_count", limit: str | Column = "max_retries",
    name: str = "state",
) -> DataFrame:
    """Steps that may still be retried and steps that are out of retries."""
    spent = F.col(retries) >= as_column(limit)
    return steps.withColumn(name, F.when(spent, "exhausted").otherwise("retryable"))


def null_profile_diff(
    a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Columns that hold NULLs in one of two mirror tables only, with both counts."""
    names = list(columns or [c for c in a.columns if c in b.columns])

    def profile(df: DataFrame, out: str) -> DataFrame:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
        return counts.unpivot([], names, "column_name", out)

    both = profile(a, "nulls_a").join(profile(b, "nulls_b"), "column_name")
    return both.filter((F.col("nulls_a") > 0) != (F.col("nulls_b") > 0))
