"""Sharding by a k-d tree over row metadata, with weighted medians.

Every node of the tree holds about equal bytes: a node is split along its widest
dimension (largest spread relative to the spread of the whole table) at the point where
the bytes on the left reach their share. All nodes of a level are split at once. The
split point is found by histograms: the bytes of each node are summed in ``BUCKETS``
equal ranges of the key, the range in which the share ends is cut again, and so on, so
what meets in one place is ``BUCKETS`` numbers for each node. Rows with one value of the
dimension are told apart by the hash of their text and then by their id: equal texts
stay in one shard unless a split point lies inside their group.

Law: ``bytes``. Defined results: NULL text has size 1 and the CRC of an empty text; NULL
or equal ids and repeated rows are placed like others (rows alike in everything stay in
one shard, so a split point inside such a run moves to its end); an empty table gives an
empty result. Columns other than the id, the text and the dimensions are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.session import materialize

BUCKETS = 4096
SLOT_BUCKETS = 4096
TOLERANCE = 0.005  # a group of equal texts up to this part of a node's share is not cut


def byte_size(text: str) -> Column:
    return F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint") + 1


def text_crc(text: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).cast("bigint")


def kd_shards(
    df: DataFrame,
    shards: int | None = None,
    *,
    target_bytes: int | None = None,
    id_: str = "doc_id",
    text: str = "text",
    dims: Sequence[Column] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per row: the id, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Either the number of shards or the bytes each should reach is given. ``dims`` are
    integer expressions on ``df``; by default the code points of the text and its bytes per
    code point, which tell scripts apart: equal texts are equal in both, so they stay together. The tree is built level by level on the stored
    metadata; the texts are read once.
    """
    points_of = F.char_length(F.coalesce(F.col(text), F.lit("")))
    own = dims or [points_of, F.floor(1000 * byte_size(text) / (points_of + 1))]
    names = [f"_d{i}" for i in range(len(own))]
    points = df.select(
        F.col(id_),
        byte_size(text).alias("size"),
        text_crc(text).alias("text_crc32"),
        *[F.coalesce(d.cast("bigint"), F.lit(0)).alias(n) for d, n in zip(own, names)],
        # The id, whatever its type, as a number that orders rows of one text.
        F.coalesce(F.col(id_).cast("bigint"), F.xxhash64(id_)).alias("_tie")
        if df.schema[id_].dataType.typeName() in ("long", "integer")
        else F.xxhash64(id_).alias("_tie"),
    )
    points = materialize(points.withColumn("_node", F.lit(0)), "kd")
    if shards is None:
        total = points.agg(F.sum("size").alias("n")).first()["n"] or 0
        shards = max(1, -(-total // target_bytes))
    spans = {0: (0, shards)}  # node -> its shards [first, end)
    whole = _spreads(points, names).select(*[F.col(n) for n in names]).toPandas()
    scale = [float(whole[n].max()) if len(whole) else 0.0 for n in names]
    while any(end - first > 1 for first, end in spans.values()):
        points, spans = _split_level(points, spans, names, scale, buckets)
    placed = points.withColumnRenamed("_node", "shard")
    return _slots(placed, id_).select(id_, "size", "text_crc32", F.col("shard").cast("int"), "slot")


def _spreads(points: DataFrame, names: Sequence[str]) -> DataFrame:
    spread = [(F.max(n) - F.min(n)).cast("double").alias(n) for n in names]
    return points.groupBy("_node").agg(F.sum("size").alias("_total"), *spread)


def _split_level(points, spans, names, scale, buckets):
    """Split every node that holds more than one shard; nodes are named by their first
    shard, and there are never more nodes than shards."""
    spark = points.sparkSession
    open_nodes = {n: s for n, s in spans.items() if s[1] - s[0] > 1}
    facts = {r["_node"]: r for r in _spreads(points, names).collect()}
    todo, after = [], {}
    for node, (first, end) in spans.items():
        if node not in open_nodes:
            after[node] = (first, end)
            continue
        mid = (first + end) // 2
        after[first], after[mid] = (first, mid), (mid, end)
        if node in facts:
            row = facts[node]
            widths = [row[n] / s if s else 0.0 for n, s in zip(names, scale)]
            share = row["_total"] * (mid - first) / (end - first)
            todo.append((node, widths.index(max(widths)), float(share), mid))
    if not todo:
        return points, after
    plan = spark.createDataFrame(todo, "_node int, _dim int, _share double, _mid int")
    value = F.element_at(F.array(*names), F.col("_dim") + 1)
    levels = [value, F.col("text_crc32"), F.col("_tie")]
    rows = points.join(F.broadcast(plan), "_node")  # at most one row per shard
    # The prefix of the cut found so far: fixed keys, then a range of the next key.
    cut = {n: {"fixed": [], "low": 0, "high": 0, "sum": 0, "at": 0} for n, *_ in todo}
    for depth, key in enumerate(levels):
        cut = _find(rows, cut, levels[:depth], key, buckets, {n: s for n, _, s, _ in todo}, depth == 2)
    state = [(n, *c["fixed"]) for n, c in cut.items()]
    ends = spark.createDataFrame(state, "_node int, _c0 bigint, _c1 bigint, _c2 bigint")
    placed = points.join(F.broadcast(plan), "_node", "left").join(F.broadcast(ends), "_node", "left")
    right = F.struct(*levels) > F.struct("_c0", "_c1", "_c2")
    node = F.when(right, F.col("_mid")).otherwise(F.col("_node"))
    moved = placed.withColumn("_node", F.coalesce(node, F.col("_node")).cast("int"))
    return materialize(moved.select(*points.columns), "kd"), after


def _find(rows, cut, fixed_keys, key, buckets, share, last):
    """Fix one more key of each node's cut: the smallest value at which the bytes of the
    rows up to it, among those that agree with the cut so far, reach the share. At the
    last key, rows of at most ``TOLERANCE`` of the share stay together."""
    spark = rows.sparkSession
    names = [f"_f{i}" for i in range(len(fixed_keys))]
    fields = "".join(f", {n} bigint" for n in names)

    def within():
        table = [(n, *c["fixed"]) for n, c in cut.items()]
        there = rows.join(F.broadcast(spark.createDataFrame(table, f"_node int{fields}")), "_node")
        for k, n in zip(fixed_keys, names):
            there = there.filter(k == F.col(n))
        return there.select("_node", key.alias("_key"), "size")

    inside = within()
    ends = inside.groupBy("_node").agg(
        F.min("_key").alias("a"), F.max("_key").alias("b"), F.sum("size").alias("n")
    )
    for r in ends.collect():
        whole = last and r["n"] <= TOLERANCE * share[r["_node"]]
        cut[r["_node"]].update(low=r["b"] if whole else r["a"], high=r["b"], at=r["n"])
    while any(c["low"] < c["high"] for c in cut.values()):
        active = {n: c for n, c in cut.items() if c["low"] < c["high"]}
        steps = {n: -(-(c["high"] - c["low"] + 1) // buckets) for n, c in active.items()}
        table = [(n, c["low"], c["high"], steps[n], float(share[n] - c["sum"])) for n, c in active.items()]
        ranges = spark.createDataFrame(table, "_node int, _low bigint, _high bigint, _step bigint, _left double")
        here = inside.join(F.broadcast(ranges), "_node").filter("_key between _low and _high")
        bucket = F.expr("(_key - _low) div _step")
        sums = here.groupBy("_node", bucket.alias("_bucket")).agg(F.sum("size").alias("_size"), F.first("_left").alias("_left"))
        order = Window.partitionBy("_node").orderBy("_bucket")
        sums = sums.withColumn("_upto", F.sum("_size").over(order))
        # One row per node: the first bucket that reaches the share, or the last one.
        reach = F.col("_upto") >= F.col("_left")
        hit = sums.groupBy("_node").agg(
            F.min(F.when(reach, F.struct("_bucket", (F.col("_upto") - F.col("_size")).alias("before"), "_size"))).alias("hit"),
            F.max(F.struct("_bucket", (F.col("_upto") - F.col("_size")).alias("before"), "_size")).alias("end"),
        )
        for r in hit.collect():
            at = r["hit"] or r["end"]
            c = active[r["_node"]]
            low = c["low"] + at["_bucket"] * steps[r["_node"]]
            c.update(low=low, high=min(c["high"], low + steps[r["_node"]] - 1), sum=c["sum"] + at["before"], at=at["_size"])
    for n, c in cut.items():
        # The last row goes to the side on which it leaves the bytes nearer to the share.
        over = last and 2 * (share[n] - c["sum"]) < c["at"]
        c["fixed"] = [*c["fixed"], c["low"] - over]
    return cut


def _slots(placed: DataFrame, id_: str, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps: rows are numbered inside hash
    buckets of their shard, and only the bucket counts meet in one place."""
    bucketed = placed.withColumn("_bucket", F.pmod(F.xxhash64(id_, "text_crc32"), F.lit(buckets)))
    counts = bucketed.groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(id_, "text_crc32", "size")
    numbered = bucketed.withColumn("_number", F.row_number().over(inside)).join(starts, ["shard", "_bucket"])
    return numbered.withColumn("slot", F.col("_start") + F.col("_number") - 1)
