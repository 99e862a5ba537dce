"""Set operations on whole rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*arms: DataFrame) -> DataFrame:
    """Stack aligned arms, duplicates kept; columns are matched by name."""
    return reduce(DataFrame.unionByName, arms)


def missing(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Distinct expected rows that the actual rows do not contain."""
    return expected.subtract(actual.select(*expected.columns))
