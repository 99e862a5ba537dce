"""Row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.scalar import as_column


def where_null(df: DataFrame, c: str | Column) -> DataFrame:
    return df.filter(as_column(c).isNull())


def where_present(df: DataFrame, c: str | Column) -> DataFrame:
    return df.filter(as_column(c).isNotNull())


def one_of(df: DataFrame, c: str | Column, values: Sequence) -> DataFrame:
    return df.filter(as_column(c).isin(*values))


def like(df: DataFrame, c: str | Column, pattern: str, negate: bool = False) -> DataFrame:
    match = as_column(c).like(pattern)
    return df.filter(~match if negate else match)


def needs_refresh(
    bills: DataFrame, versions: DataFrame, *, version_id: str, expected: str, stored: str
) -> DataFrame:
    """Bills whose expected text version is known and differs from the stored one,
    a bill without a stored version included. ``versions`` is unique on ``version_id``."""
    known = bills.filter(F.col(expected).isNotNull())
    have = versions.select(version_id, stored)
    return known.join(have, version_id, "left").filter(~F.col(expected).eqNullSafe(F.col(stored)))


def subset(df: DataFrame, name: str, subsets: Mapping[str, Column]) -> DataFrame:
    """A named, filtered relation; the predicate is pushed into the Parquet scan."""
    return df.filter(subsets[name])


def model_subsets() -> dict[str, Column]:
    """Predicates of the filtered relations the data model names."""
    return {
        "active_questions": F.col("active"),
        "fetched_versions": F.col("fetched_at").isNotNull(),
        "unfetched_versions": F.col("fetched_at").isNull(),
        "alias_positions": F.col("lis_member_id").isNotNull(),
        "sub_amendments": F.col("parent_amendment_id").isNotNull(),
        "committee_sponsored": F.col("sponsor_committee_id").isNotNull(),
        "amendment_votes": F.col("amendment_id").isNotNull(),
        "ready_bills": F.col("has_votes") & F.col("all_passes_completed"),
    }
