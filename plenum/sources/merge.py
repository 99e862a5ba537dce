"""Merging new rows into a table that is a plain DataFrame.

Each function returns the new content of the table. Applying the same source twice
gives the same table as applying it once. The exception are rows with a NULL in
their key: they never conflict, as under a UNIQUE constraint, so they are inserted
each time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.scalar import as_column
from plenum.operators.skew import HASH, distinct_keys, key_hash
from plenum.operators.windows import top_per_key
from plenum.session import materialize


def _complete(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])


def _one_per_key(src: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Source rows with a complete key, the first in ``order`` for each key."""
    return top_per_key(src.filter(_complete(keys)), keys, order, 1)


def _absent(src: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target lacks. The keys present in both are found
    first: when the source is small both steps run without shuffling the target."""
    shared = target.select(*keys).join(src.select(*keys), list(keys), "left_semi")
    return src.join(shared, list(keys), "left_anti")


def insert_if_absent(
    target: DataFrame, src: DataFrame, keys: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """Insert source rows whose key is new; stored rows are never changed. Of
    several source rows for one key the first in ``order`` is taken."""
    src = src.select(*target.columns)
    fresh = _absent(_one_per_key(src, keys, order), target, keys)
    return target.unionByName(fresh).unionByName(src.filter(~_complete(keys)))


def upsert(
    target: DataFrame,
    src: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    order: Sequence[Column | str],
) -> DataFrame:
    """Insert new keys; for stored keys overwrite only ``update_cols``. Of several
    source rows for one key the first in ``order`` wins."""
    src = src.select(*target.columns)
    delta = _one_per_key(src, keys, order)
    changes = delta.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in update_cols], F.lit(True).alias("_hit")
    )
    updated = target.join(changes, list(keys), "left").select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in update_cols
            else F.col(c)
            for c in target.columns
        ]
    )
    fresh = _absent(delta, target, keys)
    return updated.unionByName(fresh).unionByName(src.filter(~_complete(keys)))


def replace_by_key(target: DataFrame, src: DataFrame, key: str) -> DataFrame:
    """Replace all children of the parents that occur in the source. Children
    without a parent key stay; they are set aside so that they are not shuffled."""
    parents = distinct_keys(src.filter(F.col(key).isNotNull()), [key])
    owned = target.filter(F.col(key).isNotNull())
    kept = owned.join(parents, key, "left_anti").select(*target.columns)
    loose = target.filter(F.col(key).isNull())
    return kept.unionByName(loose).unionByName(src.select(*target.columns))


def enrich(
    target: DataFrame,
    src: DataFrame,
    keys: Sequence[str],
    owned_cols: Sequence[str],
    order: Sequence[Column | str],
) -> DataFrame:
    """Merge a source that knows only some columns. Its non-NULL values replace
    stored ones in ``owned_cols``; nothing else is touched, and a NULL never
    replaces a value. New keys become placeholder rows."""
    delta = _one_per_key(src, keys, order).select(*keys, *owned_cols)
    changes = delta.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in owned_cols])
    merged = target.join(changes, list(keys), "left").select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in owned_cols else F.col(c)
            for c in target.columns
        ]
    )
    placeholders = _absent(delta, target, keys)
    return merged.unionByName(placeholders, allowMissingColumns=True).select(*target.columns)


def archive_changed(
    current: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    at: str | Column,
    *,
    updated: str | None = None,
    archived_at: str = "archived_at",
) -> DataFrame:
    """The rows about to be overwritten, with the instant they were archived. With
    ``updated`` only rows whose incoming value is newer are taken; a placeholder,
    having none, always counts as older."""
    newest = incoming.filter(_complete(keys))
    if updated:
        newest = newest.groupBy(*keys).agg(F.max(updated).alias("_incoming"))
        joined = current.join(newest, list(keys))
        joined = joined.filter(
            F.col(updated).isNull() | (F.col("_incoming") > F.col(updated))
        )
    else:
        joined = current.join(newest.select(*keys).distinct(), list(keys))
    instant = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    return joined.select(*current.columns, instant.alias(archived_at))


def archive_children(
    children: DataFrame, history: DataFrame, keys: Mapping[str, str], history_id: str
) -> DataFrame:
    """Child rows of archived parents, filed under the parent's history row.
    ``keys`` maps child columns to history columns."""
    parents = history.select(
        F.col(history_id), *[F.col(parent).alias(child) for child, parent in keys.items()]
    )
    return children.join(parents, list(keys)).select(history_id, *children.columns)


def cascade_delete(
    tables: Mapping[str, DataFrame],
    cascades: Sequence[tuple[str, Sequence[str], str, Sequence[str]]],
    root: str,
    doomed: DataFrame,
) -> dict[str, DataFrame]:
    """Delete rows of ``root`` and everything that cascades from them.

    ``cascades`` lists ``(child, child columns, parent, parent columns)``, self references
    and loops included; ``doomed`` holds key columns of the root rows to delete. Returns the
    tables that can change, with the surviving rows.

    Parents come before children. A table whose doomed keys are complete is read once to
    store the keys that its lost rows pass on, all of them in one pass, and once more for
    its survivors. Tables that refer to themselves or in a loop are reduced to their key
    columns; from these each round looks up only the keys that the round before found new,
    until there are none. NULL keys refer to nothing.
    """
    doom: dict[str, list[tuple[tuple[str, ...], DataFrame]]] = {root: [(tuple(doomed.columns), doomed)]}

    def pass_on(lost: DataFrame, references) -> list:
        """The keys that lost rows pass on, stored: (child, child columns, keys)."""
        columns = list(dict.fromkeys(c for _, _, _, cols in references for c in cols))
        if not columns:
            return []
        stored = materialize(distinct_keys(lost, columns), "doomed")
        return [
            (child, tuple(ours), stored.select(*[F.col(p).alias(c) for c, p in zip(ours, theirs, strict=True)]))
            for child, ours, _, theirs in references
        ]

    reach = _reach(root, cascades)
    for group in _parents_first(reach, cascades):
        inner = [c for c in cascades if c[0] in group and c[2] in group]
        outer = [c for c in cascades if c[0] not in group and c[2] in group]
        if inner:
            narrow = {n: materialize(_key_columns(tables[n], n, cascades, doom.get(n, [])), "keys") for n in group}
            _close(narrow, inner, doom, pass_on)
        else:
            narrow = {n: tables[n] for n in group}
        for name in group:
            for child, ours, keys in pass_on(_split(narrow[name], doom[name])[0], [c for c in outer if c[2] == name]):
                doom.setdefault(child, []).append((ours, keys))
    return {name: _split(tables[name], doom[name])[1].select(*tables[name].columns) for name in reach}


def _split(table: DataFrame, doom: Sequence[tuple[tuple[str, ...], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The rows that some doomed key names, and the others."""
    by_columns: dict[tuple[str, ...], DataFrame] = {}
    for columns, keys in doom:
        by_columns[columns] = by_columns[columns].union(keys) if columns in by_columns else keys
    survivors, lost = table, None
    for columns, keys in by_columns.items():
        # Joined on key and hash: a child that refers to the same key is then
        # shuffled afresh, and its hot partitions can be split (see ``skew``).
        on = [*columns, HASH]
        hashed = survivors.withColumn(HASH, key_hash(columns))
        keys = distinct_keys(keys, columns).withColumn(HASH, key_hash(columns))
        part = hashed.join(keys, on, "left_semi").select(*table.columns)
        lost = part if lost is None else lost.unionByName(part)
        survivors = hashed.join(keys, on, "left_anti").select(*table.columns)
    return table.filter(F.lit(False)) if lost is None else lost, survivors


def _key_columns(table: DataFrame, name: str, cascades, doom) -> DataFrame:
    """The columns by which a table is referred to, refers to others, or is doomed."""
    wanted = {c for columns, _ in doom for c in columns}
    for child, ours, parent, theirs in cascades:
        wanted |= set(ours if child == name else []) | set(theirs if parent == name else [])
    return table.select(*[c for c in table.columns if c in wanted]).distinct()


def _close(narrow: Mapping[str, DataFrame], inner, doom, pass_on) -> None:
    """Adds to ``doom`` all keys that tables in a loop pass on to each other."""
    fresh = {name: doom.get(name, []) for name in narrow}
    while fresh:
        found: dict[str, list] = {}
        for name, keys in fresh.items():
            if not keys:
                continue
            for child, ours, new in pass_on(_split(narrow[name], keys)[0], [c for c in inner if c[2] == name]):
                for columns, known in doom.get(child, []):
                    if columns == ours:
                        new = new.join(known, list(ours), "left_anti")
                new = materialize(distinct_keys(new.dropna(), ours), "doomed")
                if not new.isEmpty():
                    found.setdefault(child, []).append((ours, new))
                    doom.setdefault(child, []).append((ours, new))
        fresh = found
    for name in narrow:
        doom.setdefault(name, [])


def _reach(root: str, cascades) -> list[str]:
    """The root and all tables that its deletions can reach."""
    found = [root]
    for parent in found:
        found += sorted({c for c, _, p, _ in cascades if p == parent} - set(found))
    return found


def _parents_first(reach: Sequence[str], cascades) -> list[list[str]]:
    """Groups of tables, every parent in its child's group or before it. Tables share a group
    if each can be reached from the other."""
    below = {t: set(_reach(t, cascades)) for t in reach}
    groups, placed = [], set()
    # A table reaches more tables than any that it reaches but that do not reach it.
    for table in sorted(reach, key=lambda t: (-len(below[t]), t)):
        if table not in placed:
            group = sorted(t for t in reach if t in below[table] and table in below[t])
            groups.append(group)
            placed |= set(group)
    return groups
