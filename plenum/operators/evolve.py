"""Table evolution: each change takes a DataFrame and returns the new form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.scalar import first_match
from plenum.operators.ids import assign_ids
from plenum.operators.joins import drop_orphans, lookup_update, map_pairs


def add_column(df: DataFrame, name: str, type_: str, default=None) -> DataFrame:
    """Add a column with a default; a table that has it stays as it is."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(default).cast(type_))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def retype(df: DataFrame, name: str, type_: str, using: Column | None = None) -> DataFrame:
    """Change a column's type, by way of an expression if one is given."""
    value = F.col(name) if using is None else using
    return df.withColumn(name, value.cast(type_))


def backfill(df: DataFrame, name: str, cases: Sequence[tuple[Column, object]]) -> DataFrame:
    """Fill NULLs of a column by the first case that holds; set values stay."""
    value = first_match(cases)
    return df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)


def split_union(df: DataFrame, column: str, kind: str, kinds: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Split an overloaded code column into a kind and one subtype column per kind.
    ``kinds`` maps a kind to its subtype column and the codes it covers."""
    code = F.col(column)
    out = {kind: first_match([(code.isin(*codes), value) for value, (_, codes) in kinds.items()])}
    for sub, codes in kinds.values():
        out[sub] = F.when(code.isin(*codes), code)
    return df.withColumns(out).drop(column)


def split_bridge(
    df: DataFrame, key: str, ref: str, refs: DataFrame, ref_natural: str, ref_id: str,
    *, id_: str = "id", after: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Split a mapping table in two: a dimension with one row and a new id per
    ``key``, and a bridge of id pairs between that dimension and ``refs``."""
    dimension = assign_ids(df.select(key).dropna().distinct(), key, after=after, id_=id_)
    bridge = map_pairs(
        df.select(key, ref), dimension, refs,
        left_on=(key, key), right_on=(ref, ref_natural), left_id=id_, right_id=ref_id,
        names=(f"{key}_id", f"{ref}_id"),
    )
    return dimension, bridge


def collapse(
    results: DataFrame, steps: DataFrame, run: str, step_id: str, new: str = "step_id"
) -> DataFrame:
    """Point results at a step instead of a run: each takes the smallest step id of
    its run, and results of runs without steps are dropped."""
    kept = drop_orphans(results.filter(F.col(run).isNotNull()), steps, run, run)
    pointed = lookup_update(kept, steps, {run: run}, {new: step_id}, pick="min")
    return pointed.drop(run)


def to_child(
    df: DataFrame, keys: Sequence[str], stages: Mapping[str, str], *, stage: str, value: str
) -> DataFrame:
    """Repeated columns turned into child rows, one per stage that has a value.
    ``stages`` maps a column to its stage name."""
    wide = df.select(*keys, *[F.col(c).alias(s) for c, s in stages.items()])
    return wide.unpivot(list(keys), list(stages.values()), stage, value).filter(F.col(value).isNotNull())


def code_to_id(
    df: DataFrame, lookup: DataFrame, column: str, code: str, id_: str, new: str
) -> DataFrame:
    """Replace a text code by the id of its lookup row; unknown codes become NULL."""
    return lookup_update(df, lookup, {column: code}, {new: id_}).drop(column)


def reset_vector(df: DataFrame, column: str) -> DataFrame:
    """Empty a vector column whose width changed; the rows join the embed backlog."""
    return df.withColumn(column, F.lit(None).cast("array<float>"))
