"""Joins: identity resolution, lookups, key remapping, pairing.

The lookup side of every join is unique on its key, so a join never multiplies
rows. Join strategies are left to Spark: a side is broadcast when its size is
known to be small, and AQE splits skewed partitions of the larger side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.scalar import typed_null
from plenum.operators.skew import distinct_keys, grouped_for_join


def resolve_identity(
    positions: DataFrame,
    mapping: DataFrame,
    direct: str = "member_id",
    alias: str = "lis_member_id",
) -> DataFrame:
    """Rows with one identity, whichever of two they were recorded under.

    Rows with a direct id pass through with the alias set to NULL. Rows recorded
    under an alias get the direct id from the mapping; unmapped aliases drop out,
    and an alias mapped to several ids gives one row each.
    """
    type_ = positions.schema[alias].dataType.simpleString()
    own = positions.filter(F.col(direct).isNotNull()).select(
        *[typed_null(alias, type_) if c == alias else F.col(c) for c in positions.columns]
    )
    recorded = positions.filter(F.col(alias).isNotNull()).drop(direct)
    through = recorded.join(mapping.select(alias, direct), alias).select(*positions.columns)
    return own.unionByName(through)


def map_pairs(
    links: DataFrame, left: DataFrame, right: DataFrame, *,
    left_on: tuple[str, str], right_on: tuple[str, str], left_id: str, right_id: str,
    names: tuple[str, str],
) -> DataFrame:
    """Turn a table of natural-key pairs into surrogate-id pairs; a pair with an
    unknown key drops out. ``left_on`` is (column of links, column of left)."""
    left_keys = left.select(F.col(left_on[1]).alias(left_on[0]), F.col(left_id).alias("_left"))
    right_keys = right.select(F.col(right_on[1]).alias(right_on[0]), F.col(right_id).alias("_right"))
    rest = [c for c in links.columns if c not in (left_on[0], right_on[0])]
    return (
        links.join(left_keys, left_on[0])
        .join(right_keys, right_on[0])
        .select(F.col("_left").alias(names[0]), F.col("_right").alias(names[1]), *rest)
    )


def lookup_update(
    df: DataFrame,
    lookup: DataFrame,
    on: Mapping[str, str],
    set_: Mapping[str, str],
    *,
    where: Column | None = None,
    pick: str | None = None,
) -> DataFrame:
    """``UPDATE ... FROM``: matched rows take the lookup's value, others keep theirs.

    ``on`` maps columns of ``df`` to lookup columns, ``set_`` maps columns to set to
    lookup columns. ``where`` restricts which rows may change. With several lookup
    rows per key give ``pick="min"``, which takes the smallest value of each.
    """
    keys = [F.col(theirs).alias(f"_on_{mine}") for mine, theirs in on.items()]
    if pick == "min":
        values = [F.min(theirs).alias(f"_set_{mine}") for mine, theirs in set_.items()]
        rows = lookup.select(*keys, *dict.fromkeys(set_.values()))
        source = grouped_for_join(rows, [f"_on_{mine}" for mine in on], *values)
    elif pick is None:
        source = lookup.select(*keys, *[F.col(t).alias(f"_set_{m}") for m, t in set_.items()])
    else:
        raise ValueError("pick must be 'min' or None")
    source = source.withColumn("_hit", F.lit(True))
    same = [F.col(mine) == F.col(f"_on_{mine}") for mine in on]
    hit = F.col("_hit") if where is None else F.col("_hit") & where
    joined = df.join(source, same, "left")
    return joined.select(
        *[
            F.when(hit, F.col(f"_set_{c}")).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c)
            for c in df.columns
        ],
        *[F.when(hit, F.col(f"_set_{c}")).alias(c) for c in set_ if c not in df.columns],
    )


def normalize_codes(
    df: DataFrame, col: str, lookup: DataFrame, name: str, code: str, code_length: int = 2
) -> DataFrame:
    """Replace full names by codes, whatever their case. Values that already have
    the length of a code, and unknown names, stay as they are."""
    spelled = df.withColumn("_upper", F.upper(col))
    names = lookup.select(F.upper(name).alias("_name"), F.col(code).alias("_code"))
    changed = lookup_update(
        spelled, names, {"_upper": "_name"}, {col: "_code"}, where=F.length(col) > code_length
    )
    return changed.drop("_upper")


def remap_fk(
    child: DataFrame,
    parent: DataFrame,
    fk: str,
    natural: str,
    id_: str,
    *,
    strict: bool,
    new: str | None = None,
) -> DataFrame:
    """Swap a natural-key reference for the parent's surrogate id.

    Strict: a row that finds no parent fails the query. Lenient, for history
    tables: it gets NULL. ``new`` renames the reference column.
    """
    ids = parent.select(F.col(natural).alias("_natural"), F.col(id_).alias("_id"))
    value = F.col("_id")
    if strict:
        message = F.concat(F.lit(f"no parent for {fk} = "), F.coalesce(F.col(fk).cast("string"), F.lit("NULL")))
        id_type = parent.schema[id_].dataType
        value = F.coalesce(value, F.raise_error(message).cast(id_type))
    joined = child.join(ids, F.col(fk) == F.col("_natural"), "left")
    return joined.select(
        *[value.alias(new or fk) if c == fk else F.col(c) for c in child.columns]
    )


def resolve_parent(
    df: DataFrame, natural: str, parent: str, id_: str, *, new: str | None = None
) -> DataFrame:
    """A self-reference by natural key turned into one by id; roots keep NULL."""
    return remap_fk(df, df, parent, natural, id_, strict=False, new=new)


def drop_orphans(child: DataFrame, parent: DataFrame, fk: str, key: str) -> DataFrame:
    """Keep the rows whose parent exists; rows without a reference stay."""
    known = distinct_keys(parent.select(F.col(key).alias(fk)), [fk])
    held = child.filter(F.col(fk).isNotNull()).join(known, fk, "left_semi")
    return held.select(*child.columns).unionByName(child.filter(F.col(fk).isNull()))


def processed(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work items that already have a result."""
    return work.join(done.select(key), key, "left_semi").select(*work.columns)


def unprocessed(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work items that still need one."""
    return work.join(done.select(key), key, "left_anti").select(*work.columns)


def branch_lookup(
    df: DataFrame,
    a: DataFrame,
    b: DataFrame,
    *,
    a_key: str,
    b_key: str,
    lookup_key: str,
    values: Sequence[str],
    shared: Sequence[str] = (),
) -> DataFrame:
    """Look a row up in ``a`` when its ``a_key`` is set, else in ``b`` by ``b_key``.

    ``shared`` columns must agree in either case. The two lookups are stacked under
    a tag, so every row is joined once. Rows that find nothing keep NULL values.
    """
    lookups = [
        side.select(F.lit(tag).alias("_side"), F.col(lookup_key).alias("_key"), *shared, *values)
        for tag, side in (("a", a), ("b", b))
    ]
    stacked = lookups[0].unionByName(lookups[1])
    tagged = df.withColumns(
        {
            "_side": F.when(F.col(a_key).isNotNull(), "a").otherwise("b"),
            "_key": F.coalesce(F.col(a_key), F.col(b_key)),
        }
    )
    return tagged.join(stacked, ["_side", "_key", *shared], "left").select(*df.columns, *values)


def pair(
    users: DataFrame,
    members: DataFrame,
    *,
    user_id: str = "user_id",
    member_id: str = "member_id",
    state: str = "state",
    district: str = "district",
    chamber: str = "chamber",
) -> DataFrame:
    """Users with their legislators: House by state and district, Senate by state.

    Two equi-joins rather than one OR-join. A seat has one holder (check with
    ``dup_keys``), so a user has at most a representative and two senators.
    """
    people = users.select(user_id, state, district)
    house = members.filter(F.col(chamber) == "House").select(member_id, state, district, chamber)
    senate = members.filter(F.col(chamber) == "Senate").select(member_id, state, chamber)
    columns = [user_id, member_id, state, district, chamber]
    represented = people.join(house, [state, district]).select(*columns)
    type_ = users.schema[district].dataType.simpleString()
    at_large = people.drop(district).join(senate, [state])
    return represented.unionByName(
        at_large.withColumn(district, typed_null(district, type_)).select(*columns)
    )


def stale_pairs(
    stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], status: str = "status"
) -> DataFrame:
    """Pairs to remove (``stale``) and pairs to add (``missing``). Both sides are
    stacked and grouped once instead of being joined twice."""
    sides = stored.select(*keys, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(
        recomputed.select(*keys, F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    )
    seen = sides.groupBy(*keys).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    return seen.filter(F.col("_old") != F.col("_new")).select(
        *keys, F.when(F.col("_old") == 1, "stale").otherwise("missing").alias(status)
    )
