"""A metric tree of two levels over unit vectors, for exact similarity joins.

The square root of the number of vectors is the number of cells. Their centres are found by
spherical k-means on a sample that grows with them; the centres in turn are put into groups,
again as many as the square root. A vector lies in the cell of its nearest centre. Three
bounds tell how near a vector of a cell can be to a query; a cell is visited only if none of
them rules it out:

* ball: the distance to the centre, less the cell's reach (or the cell's inner radius, less
  that distance);
* hyperplane: the cell lies on its centre's side of the plane half way to the centre that is
  nearest to the query, ``(d(q, c)^2 - d(q, near)^2) / (2 d(c, near))`` away from it;
* group: the ball bound for all cells of a group at once, so that most centres are never
  looked at.

What is kept on the driver and broadcast are the centres: the square root of the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.session import materialize

SAMPLE_PER_CELL = 32
ROUNDS = 4
HASHES = 1 << 31
# Slack for rounding when distances are compared with bounds.
SLACK = 1e-6
UNEVEN = "vectors of different widths; dim_report counts them"


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow list column as a matrix of unit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(pc.unique(pc.list_value_length(column))) != 1:
        raise ValueError(UNEVEN)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def gaps(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors."""
    if vectors.shape[1] != centres.shape[1]:
        raise ValueError(UNEVEN)
    return np.sqrt(np.maximum(2.0 - 2.0 * vectors @ centres.T, 0.0))


def _directions(sums: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Sums as unit vectors; where they vanish, what was there before."""
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(length > 1e-9, sums / np.maximum(length, 1e-9), old)


class Tree:
    """Centres in groups. ``reach`` and ``inner`` are set once the cells are filled."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        count = len(centres)
        tops = centres[:: max(1, math.isqrt(count))] if count else centres
        for _ in range(ROUNDS):
            own = gaps(centres, tops).argmin(axis=1) if count else np.zeros(0, np.int64)
            sums = np.zeros_like(tops)
            np.add.at(sums, own, centres)
            tops = _directions(sums, tops)
        own = gaps(centres, tops).argmin(axis=1) if count else np.zeros(0, np.int64)
        used = np.unique(own)
        self.tops = tops[used]
        self.groups = [np.flatnonzero(own == g) for g in used]
        self.spread = np.array([gaps(centres[m], tops[g][None]).max() for g, m in zip(used, self.groups)])
        self.reach, self.inner = np.full(count, -np.inf), np.full(count, np.inf)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each vector, and how far it is."""
        to_tops = gaps(vectors, self.tops)
        best, cell = np.full(len(vectors), np.inf), np.zeros(len(vectors), np.int64)
        # The nearest group first gives a distance that rules most of the others out.
        first = to_tops.argmin(axis=1)
        for turn in (0, 1):
            for g, members in enumerate(self.groups):
                if turn:
                    rows = np.flatnonzero((first != g) & (to_tops[:, g] - self.spread[g] <= best + SLACK))
                else:
                    rows = np.flatnonzero(first == g)
                if not len(rows):
                    continue
                found = gaps(vectors[rows], self.centres[members])
                at = found.argmin(axis=1)
                gap = found[np.arange(len(rows)), at]
                # Of equally near centres the one of the smaller number.
                better = (gap < best[rows]) | ((gap == best[rows]) & (members[at] < cell[rows]))
                best[rows[better]], cell[rows[better]] = gap[better], members[at[better]]
        return cell, best

    def within(self, vectors: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that can hold a vector up to the limit of the row."""
        near, near_gap = self.nearest(vectors)
        to_tops = gaps(vectors, self.tops)
        limits = limits + SLACK
        rows_found, cells_found = [], []
        for g, members in enumerate(self.groups):
            members = members[self.reach[members] >= 0]
            if not len(members):
                continue
            rows = np.flatnonzero(to_tops[:, g] - self.spread[g] - self.reach[members].max() <= limits)
            if not len(rows):
                continue
            gap, limit = gaps(vectors[rows], self.centres[members]), limits[rows][:, None]
            ball = np.maximum(gap - self.reach[members], self.inner[members] - gap)
            between = gaps(self.centres[near[rows]], self.centres[members])
            beyond = gap**2 - near_gap[rows][:, None] ** 2
            plane = np.where(between > SLACK, beyond / (2 * np.maximum(between, SLACK)), 0.0)
            row, cell = np.nonzero((ball <= limit) & (plane <= limit))
            rows_found.append(rows[row])
            cells_found.append(members[cell])
        if not rows_found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows_found), np.concatenate(cells_found)

    def filled(self, vectors: np.ndarray, sizes: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the nearest cells that together hold ``fill`` vectors: those of the
        nearest group, or of all groups where that holds too few."""
        first = gaps(vectors, self.tops).argmin(axis=1)
        every = np.arange(len(self.centres))
        rows_found, cells_found = [], []
        for g in np.unique(first):
            rows = np.flatnonzero(first == g)
            members = self.groups[g] if sizes[self.groups[g]].sum() >= fill else every
            for low in range(0, len(rows), 1024):
                part = rows[low : low + 1024]
                order = np.argsort(gaps(vectors[part], self.centres[members]), axis=1)
                held = np.cumsum(sizes[members][order], axis=1)
                row, place = np.nonzero(held - sizes[members][order] < fill)
                rows_found.append(part[row])
                cells_found.append(members[order[row, place]])
        return np.concatenate(rows_found), np.concatenate(cells_found)


def _some(df: DataFrame, total: int, wanted: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, or all, the same on every run: by the hash of the id."""
    share = min(1.0, (2 * wanted + 100) / max(1, total))
    return df.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(HASHES)) < int(share * HASHES))


def grow(df: DataFrame, total: int, cells: int) -> Tree:
    """A tree of at most ``cells`` cells for the vectors in column ``vec``."""
    if not total:
        return Tree(np.zeros((0, 0)))
    sample = materialize(_some(df, total, SAMPLE_PER_CELL * cells), "sample")
    first = _some(sample, total, cells).orderBy(F.md5(F.col("id").cast("string")), "id").limit(cells)
    tree = Tree(unit_rows(first.select("vec").toArrow().column("vec")))
    for _ in range(ROUNDS):
        shared = df.sparkSession.sparkContext.broadcast(tree)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            total = np.zeros_like(tree.centres)
            for batch in batches:
                if batch.num_rows:
                    vectors = unit_rows(batch.column("vec"))
                    np.add.at(total, tree.nearest(vectors)[0], vectors)
            held = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array(list(total[held]), pa.list_(pa.float64()))], names=["cell", "sum"]
            )

        def together(table: pa.Table) -> pa.Table:
            whole = np.sum(table.column("sum").to_pylist(), axis=0)
            return pa.table([table.column("cell")[:1], pa.array([whole.tolist()], pa.list_(pa.float64()))], names=["cell", "sum"])

        kind = "cell int, sum array<double>"
        # At most one row per cell comes to the driver.
        moved = sample.mapInArrow(sums, kind).groupBy("cell").applyInArrow(together, kind).toArrow()
        new = np.zeros_like(tree.centres)
        new[moved.column("cell").to_numpy()] = np.array(moved.column("sum").to_pylist())
        tree = Tree(_directions(new, tree.centres))
    return tree
