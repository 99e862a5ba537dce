"""Integrity rules as queries over a DataFrame.

A rule is a named check. As with a CHECK constraint, a check that evaluates to
NULL passes; only FALSE is a violation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.scalar import as_column, in_range
from plenum.operators.aggregates import dup_keys


@dataclass(frozen=True)
class Rule:
    name: str
    check: Column

    @property
    def broken(self) -> Column:
        return ~F.coalesce(self.check, F.lit(True))


def not_null(c: str) -> Rule:
    return Rule(f"{c}_not_null", F.col(c).isNotNull())


def exactly_one(a: str, b: str) -> Rule:
    """One of two columns is set, never both and never none."""
    return Rule(f"{a}_xor_{b}", F.col(a).isNull() != F.col(b).isNull())


def within(c: str, low=None, high=None, **ends: bool) -> Rule:
    return Rule(f"{c}_range", in_range(c, low, high, **ends))


def present_iff(c: str, condition: str | Column, name: str | None = None) -> Rule:
    """``c`` is set exactly when the condition holds; an unknown condition
    counts as not holding."""
    holds = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
    return Rule(name or f"{c}_presence", holds == F.col(c).isNotNull())


def in_domain(c: str, values: Sequence[str]) -> Rule:
    return Rule(f"{c}_domain", F.col(c).isin(*values))


def union_shape(kind: str, subtypes: Mapping[str, str], name: str | None = None) -> Rule:
    """A discriminated union: without a kind no subtype is set, otherwise exactly
    the subtype of that kind; unknown kinds fail. Written as CASE so that the
    outcome is never NULL."""
    columns = list(subtypes.values())

    def only(chosen: str | None) -> Column:
        tests = [F.col(c).isNotNull() if c == chosen else F.col(c).isNull() for c in columns]
        return reduce(Column.__and__, tests)

    shape = F.when(F.col(kind).isNull(), only(None))
    for value, column in subtypes.items():
        shape = shape.when(F.col(kind) == value, only(column))
    return Rule(name or f"{kind}_shape", shape.otherwise(F.lit(False)))


def has_width(c: str, width: int) -> Rule:
    return Rule(f"{c}_width", F.size(c) == width)


def violations(df: DataFrame, keys: Sequence[str], *rules: Rule) -> DataFrame:
    """One row per broken rule and row, all rules in one pass."""
    names = F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules])
    suspect = df.filter(reduce(Column.__or__, [r.broken for r in rules]))
    return suspect.select(*keys, F.explode(names).alias("rule")).filter(F.col("rule").isNotNull())


def unique_violations(
    df: DataFrame, keys: Sequence[str], *, where: Column | None = None, nulls_distinct: bool = True
) -> DataFrame:
    """Repeated values of a plain, composite or partial key."""
    return dup_keys(df, keys, where=where, nulls_distinct=nulls_distinct)


def orphans(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows that point at no parent; a reference with a NULL part points nowhere
    and passes. ``on`` maps child columns to parent columns."""
    pointing = child.dropna(subset=list(on))
    known = parent.select(*[F.col(p).alias(f"_parent_{c}") for c, p in on.items()])
    same = [F.col(c) == F.col(f"_parent_{c}") for c in on]
    return pointing.join(known, same, "left_anti")


def reference_violations(
    tables: Mapping[str, DataFrame], references: Sequence[tuple[str, Mapping[str, str], str]]
) -> DataFrame:
    """Orphan counts for many foreign keys: ``(child, columns, parent)``.

    Every table is scanned once. Its rows give their own key, once for each set of columns
    that references point at, and the keys they refer to; all keys meet in one shuffle,
    counted by (target, key) before it, so a key that many rows share travels as one row of
    each task. Keys compare as the common type of both columns; a reference with a NULL part
    points nowhere and passes. References without orphans have a count of 0."""
    targets: dict[tuple, list] = {}  # (parent, its columns) -> references
    for child, on, parent in references:
        targets.setdefault((parent, tuple(on.values())), []).append((child, tuple(on)))
    kinds = {target: _common_types(tables, target, refs) for target, refs in targets.items()}
    stacked, names = [], []
    for name, df in tables.items():
        keys = []
        for number, (target, refs) in enumerate(targets.items()):
            if target[0] == name:
                keys.append(_key(number, -1, target[1], kinds[target]))
            keys += [_key(number, k, own, kinds[target]) for k, (child, own) in enumerate(refs) if child == name]
        if keys:
            found = df.select(F.explode(F.array(*keys)).alias("_k")).select("_k.*")
            stacked.append(found.filter(~F.exists("key", F.isnull)))
    for number, ((parent, _), refs) in enumerate(targets.items()):
        names += [(number, k, child, ",".join(own), parent) for k, (child, own) in enumerate(refs)]
    if not names:
        raise ValueError("no references given")
    most = max(map(len, targets.values()))
    met = reduce(DataFrame.unionByName, stacked).groupBy("target", "key").agg(
        F.max(F.col("ref") < 0).alias("known"), *[F.count_if(F.col("ref") == k).alias(f"_n{k}") for k in range(most)]
    )
    lost = met.filter(~F.col("known")).groupBy("target").agg(*[F.sum(f"_n{k}").alias(f"_n{k}") for k in range(most)])
    lost = lost.select("target", F.posexplode(F.array(*[f"_n{k}" for k in range(most)])).alias("ref", "orphans"))
    spark = next(iter(tables.values())).sparkSession
    listed = spark.createDataFrame(names, "target int, ref int, child string, columns string, parent string")
    counts = listed.join(lost, ["target", "ref"], "left")
    return counts.select("child", "columns", "parent", F.coalesce("orphans", F.lit(0)).cast("bigint").alias("orphans"))


def _key(target: int, ref: int, columns: Sequence[str], kinds: Sequence[str]) -> Column:
    """A key to be met; ``ref`` is -1 for a row's own key."""
    parts = F.array(*[F.col(c).cast(k).cast("string") for c, k in zip(columns, kinds)])
    return F.struct(F.lit(target).alias("target"), F.lit(ref).alias("ref"), parts.alias("key"))


def _common_types(tables, target, refs) -> list[str]:
    """The types to which a union brings the columns of a target and its references."""
    parent, columns = target
    rows = tables[parent].select(*columns)
    for child, own in refs:
        rows = rows.union(tables[child].select(*own))
    return [f.dataType.simpleString() for f in rows.schema]


def quality_report(df: DataFrame, *rules: Rule) -> DataFrame:
    """Violations per rule out of all rows, in a single pass over the table."""
    counts = df.agg(
        F.count("*").alias("rows"), *[F.count_if(r.broken).alias(r.name) for r in rules]
    )
    return counts.unpivot(["rows"], [r.name for r in rules], "rule", "violations")


def dim_report(df: DataFrame, column: str, width: int) -> DataFrame:
    """Vectors by actual length, and whether that is the required one."""
    length = F.size(as_column(column)).alias("dimension")
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(length)
        .agg(F.count("*").alias("n"))
        .withColumn("conforms", F.col("dimension") == width)
    )
