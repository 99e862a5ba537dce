"""Exact cosine search over embeddings: one query, many queries, classification.

Joining many queries with many vectors works on the cells of a metric tree, whose
number grows with the square root of the vectors. Ball, hyperplane and group bounds
tell which cells can hold what a query is looking for; the others are never
compared, and the result is still exact. Small cells share a bin, so that a query
is sent to few places; a bin with many members is cut into blocks, and many queries
for one bin into groups. One task compares one group with one block and returns the
best matches only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from plenum.functions.vector import distance_to
from plenum.operators import metric_tree
from plenum.operators.components import connected_components
from plenum.operators.metric_tree import unit_rows
from plenum.operators.skew import grouped_for_join
from plenum.operators.windows import top_per_key
from plenum.session import materialize, release
from plenum.sources.io import seed

# Rows of either side that one task compares at a time.
BLOCK_ROWS = 4096


def knn(
    df: DataFrame, query: Sequence[float], k: int, *, id_: str, vector: str = "embedding",
    where: Column | None = None, name: str = "distance", digits: int = 9,
) -> DataFrame:
    """The ``k`` rows nearest to one query vector, optionally within a filter. Each
    task keeps its own best ``k`` before they meet."""
    rows = df if where is None else df.filter(where)
    scored = rows.withColumn(name, distance_to(vector, query, digits))
    best = scored.orderBy(F.col(name).asc_nulls_last(), id_).limit(k)
    return best.filter(F.col(name).isNotNull())


def embed_backlog(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows still without a vector, to be embedded at the next tick."""
    return df.filter(F.col(vector).isNull())


def _prepare(df: DataFrame, id_: str, vector: str) -> DataFrame:
    usable = F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)
    return df.filter(usable).select(F.col(id_).alias("id"), F.col(vector).alias("vec"))


class Cells:
    """One side of a similarity join, arranged in cells."""

    def __init__(self, df: DataFrame, block_rows: int = BLOCK_ROWS):
        df = materialize(df, "vectors")
        total = df.count()
        # Without any vectors there are no cells, and every query visits none.
        self.tree = metric_tree.grow(df, total, max(1, math.isqrt(total)))
        self.block_rows, self.total, self.compared = block_rows, total, 0
        cells = len(self.tree.centres)
        self.sizes = np.zeros(cells, np.int64)
        self.rows = self._placed(df)
        # At most one row per cell comes to the driver.
        found = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("reach"), F.min("gap").alias("inner"))
        for row in found.collect():
            self.sizes[row["cell"]] = row["n"]
            self.tree.reach[row["cell"]], self.tree.inner[row["cell"]] = row["reach"], row["inner"]
        release(df)
        self.bins = self._share_bins()

    def _placed(self, df: DataFrame) -> DataFrame:
        """The vectors with their cell and the distance to its centre."""
        shared = df.sparkSession.sparkContext.broadcast(self.tree)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                cell, gap = shared.value.nearest(unit_rows(batch.column("vec")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("vec"), pa.array(cell, pa.int32()), pa.array(gap, pa.float64())],
                    names=["id", "vec", "cell", "gap"],
                )

        schema = StructType(list(df.schema.fields)).add("cell", IntegerType()).add("gap", DoubleType())
        return materialize(df.mapInArrow(place, schema), "cells")

    def _share_bins(self) -> np.ndarray:
        """The bin of each cell: cells of a group are put together up to a block of rows."""
        bins, current, held = np.zeros(len(self.sizes), np.int64), 0, 0
        for members in self.tree.groups:
            for cell in members:
                if held and held + self.sizes[cell] > self.block_rows:
                    current, held = current + 1, 0
                bins[cell] = current
                held += self.sizes[cell]
        return bins

    def route(self, queries: DataFrame, *, fill: int | None = None, bound: str | None = None,
              skip: str | None = None, most: str | None = None) -> DataFrame:
        """Queries with the bins they have to visit, and in ``most`` the cosine distance
        beyond which they want no matches.

        ``fill``: those of the nearest cells that together hold that many vectors.
        ``bound``: those of all cells that can hold a vector within the Euclidean
        distance in that column, except the bins already listed in column ``skip``.
        """
        shared = queries.sparkSession.sparkContext.broadcast((self.tree, self.sizes, self.bins))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, sizes, bins = shared.value
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                vectors = unit_rows(batch.column("vec"))
                if not len(tree.centres):
                    row, cell = np.zeros(0, np.int64), np.zeros(0, np.int64)
                elif fill is not None:
                    row, cell = tree.filled(vectors, sizes, fill)
                else:
                    row, cell = tree.within(vectors, batch.column(bound).to_numpy(zero_copy_only=False))
                pairs = np.unique(np.stack([row, bins[cell]], axis=1), axis=0)
                chosen = np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, len(vectors))))
                if skip is not None:
                    seen = batch.column(skip).to_pylist()
                    chosen = [np.setdiff1d(c, s) for c, s in zip(chosen, seen, strict=True)]
                wanted = np.full(len(vectors), np.inf) if most is None else batch.column(most)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("vec"),
                     pa.array([c.tolist() for c in chosen], pa.list_(pa.int32())), pa.array(wanted, pa.float64())],
                    names=["id", "vec", "bins", "most"],
                )

        schema = StructType(list(queries.select("id", "vec").schema.fields))
        schema = schema.add("bins", ArrayType(IntegerType())).add("most", DoubleType())
        return materialize(queries.mapInArrow(visit, schema), "routes")

    def compare(self, routed: DataFrame, *, k: int | None, limit: float | None, digits: int,
                skip_same: bool, chains: bool = False) -> DataFrame:
        """Matches of routed queries in their bins: per block the best ``k`` of each
        query, or all matches up to the distance ``limit``. With ``chains`` a block returns
        instead, for each component that its matches form, one pair per member with the
        component's first vector (distance NULL): no more pairs than vectors, and the same
        components."""
        spark = routed.sparkSession
        visits = routed.select("id", "vec", "most", F.explode("bins").alias("bin"))
        # At most one row per bin comes to the driver.
        load = {r["bin"]: r["count"] for r in visits.groupBy("bin").count().collect()}
        held = np.bincount(self.bins, weights=self.sizes).astype(np.int64)
        self.compared += sum(n * int(held[b]) for b, n in load.items())
        plan = [
            (b, -(-int(held[b]) // self.block_rows), -(-n // self.block_rows))
            for b, n in load.items()
            if held[b]
        ]
        members = [(cell, int(b)) for cell, b in enumerate(self.bins)]
        grid = seed(spark, plan, "bin int, blocks bigint, groups bigint")
        cells = seed(spark, members, "cell int, bin int")
        id_hash, zero = F.xxhash64("id"), F.lit(0).cast("bigint")
        asking = (
            visits.join(grid, "bin")
            .withColumn("grp", F.pmod(id_hash, F.col("groups")))
            .withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
            .select("bin", "block", "grp", "id", "vec", "most")
        )
        offered = (
            self.rows.join(cells.join(grid, "bin"), "cell")
            .withColumn("block", F.pmod(id_hash, F.col("blocks")))
            .withColumn("grp", F.explode(F.sequence(zero, F.col("groups") - 1)))
            .select("bin", "block", "grp", "id", "vec")
        )
        left_type = routed.schema["id"].dataType.simpleString()
        right_type = self.rows.schema["id"].dataType.simpleString()
        names = ["left_id", "right_id", "distance"]

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                rows = cols = np.zeros(0, np.int64)
                distances = np.zeros(0)
                right_ids = right.column("id")
            else:
                right = right.sort_by("id")
                right_ids = right.column("id")
                ours_, theirs_ = unit_rows(left.column("vec")), unit_rows(right.column("vec"))
                most = left.column("most").to_numpy()
                wanted = np.minimum(most, np.inf if limit is None else limit)
                same = np.full(left.num_rows, -1)
                if skip_same:
                    at = {key: col for col, key in enumerate(right_ids.to_pylist())}
                    same = np.array([at.get(key, -1) for key in left.column("id").to_pylist()])
                rows, cols, distances = _near(ours_, theirs_, wanted, same, k, digits)
                if chains:
                    mine, theirs = _chained_pairs(rows, cols, left.num_rows, right.num_rows)
                    ours = left.column("id").take(pa.array(np.flatnonzero(mine >= 0)))
                    firsts = right_ids.take(pa.array(np.concatenate([mine[mine >= 0], theirs[theirs >= 0]])))
                    ids = pa.concat_arrays([*ours.chunks, *right_ids.take(pa.array(np.flatnonzero(theirs >= 0))).chunks])
                    return pa.table([ids, firsts, pa.nulls(len(ids), pa.float64())], names=names)
            return pa.table(
                [left.column("id").take(pa.array(rows)), right_ids.take(pa.array(cols)),
                 pa.array(distances, pa.float64())],
                names=names,
            )

        keys = ["bin", "block", "grp"]
        return asking.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(
            best, f"left_id {left_type}, right_id {right_type}, distance double"
        )


# Rows compared at a time, and pairs whose exact distance is worked out at a time.
STRIP_ROWS, EXACT_PAIRS = 512, 1 << 16


def _near(left: np.ndarray, right: np.ndarray, wanted: np.ndarray, same: np.ndarray, k: int | None, digits: int):
    """(row, column, distance) of the pairs up to the distance each row wants, but for the
    column ``same`` of a row; with ``k`` the best ``k`` of each row, of equals the first. Single precision
    rules pairs out, as far as its error allows; the others are worked out in double."""
    slack = 4e-7 * (left.shape[1] + 16) + 10.0**-digits
    small, across = left.astype(np.float32), np.ascontiguousarray(right.astype(np.float32).T)
    found = []
    for low in range(0, len(left), STRIP_ROWS):
        own = slice(low, min(low + STRIP_ROWS, len(left)))
        cos = small[own] @ across
        skipped = np.flatnonzero(same[own] >= 0)
        cos[skipped, same[own][skipped]] = -np.inf
        least = 1.0 - wanted[own] - slack
        if k is not None and k < cos.shape[1] and not np.isfinite(wanted[own]).all():
            kth = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
            least = np.maximum(least, kth.astype(np.float64) - 2 * slack)
        least = np.maximum(least, -2.0).astype(np.float32) - np.float32(1e-6)
        flat = np.flatnonzero(cos >= least[:, None])
        rows, cols = np.divmod(flat, cos.shape[1])
        if len(flat) > cos.size // 16:  # many copies: cheaper for all pairs at once
            exact = (left[own] @ right.T).ravel()[flat]
        else:
            parts = [slice(at, at + EXACT_PAIRS) for at in range(0, len(flat), EXACT_PAIRS)]
            exact = [np.einsum("ij,ij->i", left[low + rows[p]], right[cols[p]]) for p in parts]
            exact = np.concatenate([np.zeros(0), *exact])
        rows += low
        distance = np.round(1.0 - exact, digits) + 0.0
        good = distance <= wanted[rows]
        rows, cols, distance = rows[good], cols[good], distance[good]
        if k is not None:
            order = np.lexsort((cols, distance, rows))
            rows, cols, distance = rows[order], cols[order], distance[order]
            inside = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
            rows, cols, distance = rows[inside], cols[inside], distance[inside]
        found.append((rows, cols, distance))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _chained(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_chained_pairs`` for a matrix of matches."""
    return _chained_pairs(*np.nonzero(keep), *keep.shape)


def _chained_pairs(rows: np.ndarray, cols: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column the first column of the component that its matches form,
    or -1 without a match. Names go to and fro between rows and columns until they rest."""
    theirs = np.full(width, width)
    theirs[cols] = cols
    while True:
        mine = np.full(height, width)
        np.minimum.at(mine, rows, theirs[cols])
        new = theirs.copy()
        np.minimum.at(new, cols, mine[rows])
        if (new == theirs).all():
            return np.where(mine < width, mine, -1), np.where(theirs < width, theirs, -1)
        theirs = new


def knn_join(
    left: DataFrame,
    right: DataFrame,
    k: int,
    *,
    left_id: str,
    right_id: str,
    left_vector: str = "embedding",
    right_vector: str = "embedding",
    skip_same: bool = False,
    digits: int = 6,
    block_rows: int = BLOCK_ROWS,
    report: dict | None = None,
) -> DataFrame:
    """For every left row the ``k`` nearest right rows: ``left_id, right_id,
    distance, position``. Exact; ties go to the smaller id. ``skip_same`` leaves out
    the row with the same id, for joining a table with itself. ``report`` is given
    ``compared``, how many pairs of vectors are compared, and ``vectors``, how many
    there are on the right.

    The nearest cells that hold enough vectors give each query a first answer; its
    k-th distance then decides which other cells could still improve on it.
    """
    queries = _prepare(left, left_id, left_vector)
    cells = Cells(_prepare(right, right_id, right_vector), block_rows)
    first = cells.route(queries, fill=k + int(skip_same))
    options = {"k": k, "limit": None, "digits": digits, "skip_same": skip_same}
    near = materialize(cells.compare(first, **options), "near")
    order = ["distance", "right_id"]
    worst = (
        top_per_key(near, ["left_id"], order, k)
        .groupBy("left_id")
        .agg(F.max("distance").alias("worst"), F.count("*").alias("found"))
    )
    reach = F.when(F.col("found") >= k, F.sqrt(2 * (F.col("worst") + 10.0**-digits)))
    asked = (
        first.withColumnRenamed("bins", "seen")
        .join(worst, F.col("id") == F.col("left_id"), "left")
        .select(
            "id", "vec", "seen", F.coalesce(reach, F.lit(3.0)).alias("bound"),
            F.when(F.col("found") >= k, F.col("worst")).otherwise(F.lit(float("inf"))).alias("most"),
        )
    )
    rest = cells.route(asked, bound="bound", skip="seen", most="most")
    far = cells.compare(rest, **options)
    if report is not None:
        report.update(compared=cells.compared, vectors=cells.total)
    return top_per_key(near.unionByName(far), ["left_id"], order, k, "position")


def within_distance(
    left: DataFrame, right: DataFrame, limit: float, *, left_id: str, right_id: str,
    left_vector: str = "embedding", right_vector: str = "embedding", digits: int = 6,
    block_rows: int = BLOCK_ROWS, chains: bool = False,
) -> DataFrame:
    """All pairs up to a cosine distance: ``left_id, right_id, distance``. With ``chains``
    only as many pairs as join the same vectors in chains, for a table with itself."""
    queries = _prepare(left, left_id, left_vector)
    cells = Cells(_prepare(right, right_id, right_vector), block_rows)
    bound = math.sqrt(2 * (limit + 10.0**-digits))
    routed = cells.route(queries.withColumn("bound", F.lit(bound)), bound="bound")
    return cells.compare(routed, k=None, limit=limit, digits=digits, skip_same=False, chains=chains)


def classify(
    groups: DataFrame, nodes: DataFrame, tau: float, *, group_id: str, node_id: str,
    unclassified, vector: str = "embedding", digits: int = 6,
) -> DataFrame:
    """Label every group with all taxonomy nodes it scores at least ``tau`` with
    (score = cosine, in [0, 1]); a group that matches none gets the reserved
    ``unclassified`` node with score 0."""
    if not 0 < tau <= 1:
        raise ValueError("tau must be in (0, 1]")
    hits = within_distance(
        groups, nodes, round(1 - tau, 12), left_id=group_id, right_id=node_id,
        left_vector=vector, right_vector=vector, digits=digits,
    ).select(
        F.col("left_id").alias(group_id), F.col("right_id").alias(node_id),
        F.least(F.round(1 - F.col("distance"), digits), F.lit(1.0)).alias("score"),
    )
    hits = materialize(hits, "matches")
    rest = groups.select(group_id).join(hits.select(group_id), group_id, "left_anti")
    node_type = nodes.schema[node_id].dataType
    fallback = rest.select(
        group_id, F.lit(unclassified).cast(node_type).alias(node_id), F.lit(0.0).alias("score")
    )
    return hits.unionByName(fallback)


def concept_groups(
    sections: DataFrame, limit: float, *, id_: str, vector: str = "embedding", name: str = "concept_group",
    digits: int = 6, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id_, name``: sections that a chain of steps of at most ``limit`` in cosine distance
    joins form a group, named by its smallest id. Every section is in exactly one group;
    those without a vector, or with a zero vector, are groups of their own. Rows repeated
    with their id are one section; rows without an id are left out."""
    sections = sections.select(id_, vector).filter(F.col(id_).isNotNull())
    # Equal vectors are one point, named by its smallest id, and join its group as members.
    points = materialize(grouped_for_join(sections.filter(F.col(vector).isNotNull()), [vector], F.min(id_).alias("_point")), "points")
    names = points.select(F.col("_point").alias(id_), vector)
    links = within_distance(
        names, names, limit, left_id=id_, right_id=id_, left_vector=vector, right_vector=vector,
        digits=digits, block_rows=block_rows, chains=True,
    ).select("left_id", "right_id")
    usable = sections.filter(F.exists(vector, lambda x: x != 0))
    members = usable.join(points, vector).select(F.col(id_).alias("left_id"), F.col("_point").alias("right_id"))
    nodes = sections.select(id_).distinct()
    return connected_components(nodes, links.union(members), node=id_, a="left_id", b="right_id", name=name)
