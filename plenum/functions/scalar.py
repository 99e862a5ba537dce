"""Scalar expressions: typed NULLs, ranges, value maps, domains, natural keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def typed_null(name: str, type_: str) -> Column:
    """A NULL of a given type, so that the arms of a union line up."""
    return F.lit(None).cast(type_).alias(name)


def empty_array(type_: str) -> Column:
    """The empty (not NULL) default of an array column."""
    return F.array().cast(f"array<{type_}>")


def in_range(c: str | Column, low=None, high=None, *, open_low=False, open_high=False) -> Column:
    """Range predicate with open or closed ends; a missing end is unbounded."""
    value = as_column(c)
    tests = []
    if low is not None:
        tests.append(value > low if open_low else value >= low)
    if high is not None:
        tests.append(value < high if open_high else value <= high)
    return reduce(Column.__and__, tests, F.lit(True)) if tests else F.lit(True)


def map_values(c: str | Column, mapping: Mapping, otherwise: str = "keep") -> Column:
    """Simple CASE over literals. ``otherwise="keep"`` passes other values through,
    ``"null"`` turns them into NULL."""
    value = as_column(c)
    if otherwise not in ("keep", "null"):
        raise ValueError("otherwise must be 'keep' or 'null'")
    branches = F
    for old, new in mapping.items():
        branches = branches.when(value == F.lit(old), F.lit(new))
    return branches.otherwise(value) if otherwise == "keep" else branches.otherwise(F.lit(None))


def first_match(cases: Sequence[tuple[Column, object]], default=None) -> Column:
    """Searched CASE: the first condition that holds decides."""
    branches = F
    for condition, value in cases:
        branches = branches.when(condition, value if isinstance(value, Column) else F.lit(value))
    return branches.otherwise(default if isinstance(default, Column) else F.lit(default))


def to_domain(c: str | Column, values: Sequence[str], strict: bool = True) -> Column:
    """A string restricted to a closed list. Strict mode fails the query on an
    unknown value, as an enum column would; lenient mode yields NULL."""
    value = as_column(c).cast("string")
    known = value.isNull() | value.isin(*values)
    if strict:
        problem = F.raise_error(F.concat(F.lit("value outside its domain: "), value))
        return F.when(known, value).otherwise(problem.cast("string"))
    return F.when(known, value)


def natural_key(*parts: str | Column) -> Column:
    """``congress-chamber-session-roll`` style key. A missing part makes the whole
    key NULL rather than silently shortening it."""
    columns = [as_column(p).cast("string") for p in parts]
    return F.when(
        reduce(Column.__and__, [c.isNotNull() for c in columns]), F.concat_ws("-", *columns)
    )


def parse_key(c: str | Column, names: Sequence[str], types: Sequence[str]) -> list[Column]:
    """The parts of a natural key, cast to their types."""
    pieces = F.split(as_column(c), "-")
    return [
        F.try_element_at(pieces, F.lit(i + 1)).cast(type_).alias(name)
        for i, (name, type_) in enumerate(zip(names, types, strict=True))
    ]


def stamp(df: DataFrame, at: str, column: str = "created_at") -> DataFrame:
    """A load instant passed in as a literal, so that a re-run writes the same rows."""
    return df.withColumn(column, F.lit(at).cast("timestamp"))


def with_uuid(df: DataFrame, column: str = "id") -> DataFrame:
    """A random identifier per row. It changes on recomputation: write the result
    before referring to it."""
    return df.withColumn(column, F.uuid())
